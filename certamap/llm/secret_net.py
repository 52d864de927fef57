"""A small character convolutional network in numpy: embedding, one convolution, max pooling, one logit."""

from __future__ import annotations

import base64
import functools
import string
import uuid
from dataclasses import dataclass
from itertools import batched

import numpy as np

LEFT, BODY, RIGHT = 24, 64, 12
LENGTH = LEFT + BODY + RIGHT
#: Characters from one window of a long candidate to the next; a key of up to BODY - STEP + 1 characters is whole in one of them.
STEP = 16
#: Characters below 128 have an id each, all others share one; context characters have ids of their own. 0 is padding.
CHARS = 130
EMBED, WIDTH, FILTERS = 8, 7, 32
#: Labelled findings that the network is trained, and calibrated, on, besides a third as many in long runs; recall that the threshold has to keep on the latter, on the long and on the short ones alike.
TRAIN, CALIBRATE, RECALL = 9000, 2400, 0.98


def encode(before: str, body: str, after: str) -> np.ndarray:
    """Character ids of a candidate, or of a window of one (BODY characters at the most), and its surroundings."""
    ids = lambda s: [min(ord(c), 128) + 1 for c in s]
    row = np.zeros(LENGTH, np.int64)
    left, right = ids(before[-LEFT:]), ids(after[:RIGHT])
    if left:
        row[LEFT - len(left) : LEFT] = np.array(left) + CHARS
    row[LEFT : LEFT + len(body)] = ids(body)
    if right:
        row[LEFT + len(body) : LEFT + len(body) + len(right)] = np.array(right) + CHARS
    return row


def starts(n: int) -> list[int]:
    """Where the windows of a candidate of `n` characters start; together they cover all of it."""
    return [0] if n <= BODY else [*range(0, n - BODY, STEP), n - BODY]


def view(text: str, start: int, end: int, at: int) -> np.ndarray:
    """The window at `at` of the candidate text[start:end], encoded."""
    a = start + at
    b = min(end, a + BODY)
    return encode(text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT])


def labelled_findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Encoded windows of findings with labels: keys in many formats, and look-alikes that are none (words, paths, dates, versions, numbers, addresses, identifiers)."""
    x, y, _ = encoded(findings(n, seed))
    return x, y


def encoded(found: list[tuple[str, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of findings, their labels and which finding each is of. Windows that hold a part of a key only are left out, unless it fills them."""
    x, y, of = [], [], []
    for k, (text, s, e, a, b) in enumerate(found):
        for w in starts(e - s):
            lo, hi = s + w, min(e, s + w + BODY)
            whole, apart = (lo <= a and b <= hi) or (a <= lo and hi <= b), b <= lo or hi <= a
            if whole or apart:
                x.append(view(text, s, e, w))
                y.append(a < b and whole)
                of.append(k)
    return np.array(x), np.array(y, np.float64), np.array(of)


def findings(n: int, seed: int, long: bool = False) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, start of the key, its end); the key of a harmless one is empty. `long`: inside addresses and paths of more than a window."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    word = lambda: pick(string.ascii_lowercase, int(rng.integers(2, 10)))
    marks, tongue = ["", "", "", "!!", "***", "%%%", ",", "."], list(string.ascii_lowercase + "éèüßñó")

    def prose() -> str:
        mark = marks[int(rng.integers(0, len(marks)))]
        out = " ".join(pick(tongue, int(rng.integers(2, 10))) + mark for _ in range(int(rng.integers(1, 6))))
        return out.upper() if rng.random() < 0.2 else out

    size = lambda lo, hi: int(rng.integers(lo, hi))
    secrets = [
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "sk_live_" + pick(alnum, size(24, 40)),
        lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24),
        lambda: pick(alnum, size(20, 48)),
        lambda: base64.b64encode(rng.bytes(size(16, 40))).decode(),
        lambda: "eyJ" + pick(alnum, 17) + "." + pick(alnum + "_-", size(24, 60)) + "." + pick(alnum + "_-", 43),
        lambda: rng.bytes(size(12, 33)).hex(),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: pick(b64, 40),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: rng.bytes(size(16, 33)).hex(),
    ]
    short = lambda: pick(alnum, size(8, 20))
    plain = [
        lambda: "-".join(word() for _ in range(size(4, 8))),
        lambda: "_".join(word() for _ in range(size(4, 8))),
        lambda: pick(string.ascii_lowercase, size(20, 40)),
        lambda: "/".join(word() for _ in range(size(4, 8))),
        lambda: "www." + ".".join(word() for _ in range(3)) + "/" + word() + "-" + str(size(1, 9999)),
        lambda: f"{size(1990, 2030)}-{size(10, 12)}-{size(10, 28)}_{word()}_{word()}{size(1, 99)}",
        lambda: pick(string.digits, size(20, 30)),
        lambda: ".".join(word() for _ in range(4)) + f".{size(1, 20)}.{size(0, 20)}",
        lambda: word().upper() + "_" + word().upper() + "_" + word().upper() + f"_{size(1, 9999)}",
        lambda: pick("-=_.", size(20, 60)),
        lambda: word() + str(size(1, 99)) + "." + word() + str(size(1, 99)) + "-" + "".join(word().title() for _ in range(3)),
        lambda: pick(string.digits, size(12, 20)),
        lambda: pick(string.digits, 16),
        lambda: ".".join(str(size(0, 256)) for _ in range(4)),
        lambda: word() + str(size(1, 99)) + ".example." + ("com", "org", "net")[size(0, 3)],
        lambda: "".join(word().title() for _ in range(size(2, 5))) + ("", ".java", ".py", "2")[size(0, 4)],
        lambda: word() + word() + word()[:3] + ".",
        lambda: str(uuid.UUID(bytes=rng.bytes(16))),
        lambda: f"{size(1, 30)}.{size(0, 30)}.{size(0, 30)}-" + ("beta", "rc", "alpha", "snapshot")[size(0, 4)] + str(size(1, 9)),
        lambda: "+" + pick(string.digits, 2) + "-" + pick(string.digits, 3) + "-" + pick(string.digits, 7),
    ]
    # what such a word announces is a hash, not a key
    hashes = ["commit ", "sha1: ", "md5=", "checksum ", "digest: ", "etag="]
    tame = ["version = ", "color=", "name: ", "path=", "id: ", "user = ", "file: ", "lang="]
    asks = ["key: ", "key = ", 'secret="', "token ", "Authorization: Bearer ", "auth=", "export K=", "password = ", 'token = "', "api_key:", "passwd=", "credential: "]
    parts = [
        word,
        word,
        lambda: word() + "-" + word(),
        lambda: f"v{size(1, 30)}",
        lambda: f"{size(1990, 2030)}/{size(10, 13)}/{size(10, 29)}",
        lambda: word().title() + word().title(),
        lambda: str(size(1, 10 ** size(2, 8))),
        lambda: word() + "_" + word() + str(size(1, 99)),
        lambda: word() + "=" + str(size(1, 9999)),
    ]
    run = lambda k: "/".join(parts[size(0, len(parts))]() for _ in range(k))
    ends = ["", ".html", ".json", ".tar.gz", "/", ".png"]
    out = []
    for i in range(n):
        good = i % 2 == 0
        body = (secrets if good else plain)[size(0, len(secrets if good else plain))]()
        chance = rng.random()
        lead = asks[size(0, len(asks))] if chance < (0.5 if good else 0.08) else "" if good or chance < 0.7 else tame[size(0, len(tame))]
        if not long and good and chance > 0.7:
            body, lead = short(), asks[size(0, len(asks))]
            if chance > 0.85:  # the name and the value are one run
                body, lead = ("key=", "auth=", "token=", "K=", "pwd=", "api_key=")[size(0, 6)] + body, ""
        if not long and not good and chance > 0.9:
            body, lead = rng.bytes(size(8, 33)).hex(), hashes[size(0, len(hashes))]
        before = (prose() + " " if rng.random() < 0.95 else "") + lead
        head = tail = ""
        if long:
            head = ("//" + ".".join(word() for _ in range(3)) if rng.random() < 0.6 else "") + "/" + run(size(1, 9)) + "/"
            tail = "/" + run(size(1, 9)) + ends[size(0, len(ends))]
            while len(head + body + tail) <= BODY:
                head, tail = head + run(1) + "/", "/" + run(1) + tail
            before = prose() + (" https:" if rng.random() < 0.5 else " ")
        s = len(before)
        a = s + len(head)
        b = a + len(body)
        out.append((before + head + body + tail + " " + prose(), s, b + len(tail), a, b if good else a))
    return out


@dataclass
class Net:
    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = self.emb[x]
        wide = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)
        return wide.transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, WIDTH * EMBED)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self._patches(x) @ self.conv + self.bias, 0).max(axis=1)
        return h @ self.out[:-1] + self.out[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        parts = [1 / (1 + np.exp(-(self.slope * self.logits(x[i : i + 512]) + self.shift))) for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def best(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """The score of every candidate (text, start, end): the highest of its windows'."""
        top = np.zeros(len(found))
        jobs = ((k, w) for k, (_, s, e) in enumerate(found) for w in starts(e - s))
        for part in batched(jobs, 512):
            np.maximum.at(top, [k for k, _ in part], self.scores(np.array([view(*found[k], w) for k, w in part])))
        return top


def _fit(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 12, rate: float = 0.01) -> Net:
    rng = np.random.default_rng(seed)
    shapes = (0.3, (2 * CHARS, EMBED)), ((2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)), (0.0, FILTERS), (0.2, FILTERS + 1)
    net = Net(*(rng.normal(0, dev, shape).astype(np.float32) for dev, shape in shapes))
    params = [net.emb, net.conv, net.bias, net.out]
    mean, var, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            xb, yb = x[batch], y[batch]
            patches = net._patches(xb)
            act = patches @ net.conv + net.bias
            at = act.argmax(axis=1)  # [n, f]
            top = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0]
            h = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-(h @ net.out[:-1] + net.out[-1])))
            g = ((p - yb) / len(batch)).astype(np.float32)
            dh = np.outer(g, net.out[:-1]) * (top > 0)
            rows = np.arange(len(batch))[:, None]
            chosen = patches[rows, at]  # [n, f, width * embed]
            d_conv = np.einsum("nfk,nf->kf", chosen, dh)
            d_patch = (dh[:, :, None] * net.conv.T[None]).reshape(-1, WIDTH, EMBED)
            d_emb = np.zeros_like(net.emb)
            spots = (at[:, :, None] + np.arange(WIDTH)).reshape(len(batch), -1)
            np.add.at(d_emb, xb[rows, spots].ravel(), d_patch.reshape(-1, EMBED))
            grads = [d_emb, d_conv, dh.sum(axis=0), np.append(h.T @ g, g.sum())]
            t += 1
            for q, gr, m, v in zip(params, grads, mean, var, strict=True):
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


@functools.cache
def trained(train: int = TRAIN, calibrate: int = CALIBRATE, recall: float = RECALL, seed: int = 5) -> Net:
    """The network, calibrated by a logistic fit on findings it has not seen, with the highest threshold that keeps `recall` of the true ones, of the long ones too."""
    x, y, _ = encoded(findings(train, seed) + findings(train // 3, seed + 2, long=True))
    net = _fit(x, y, seed)
    held = [findings(calibrate, seed + 1), findings(calibrate // 3, seed + 3, long=True)]
    x, y, _ = encoded(held[0] + held[1])
    z = np.concatenate([net.logits(x[i : i + 512]) for i in range(0, len(x), 512)]).astype(float)
    z = np.clip(z, -30, 30)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum()])
        hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    net.slope, net.shift = float(a), float(b)
    keeps, named = [], [f for f in held[0] if f[2] - f[1] < 26]  # the short ones among them once more, as they are the hardest
    for found in [*held, named]:
        true = [(t, s, e) for t, s, e, a, b in found if a < b]
        keeps.append(np.sort(net.best(true))[int((1 - recall) * len(true))])
    net.threshold = float(min(keeps))
    return net
