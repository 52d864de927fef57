"""Fixed values of the census dictionaries, weights and thresholds."""

KIND_LABELS = {
    1: "Domicílio Particular",
    2: "Domicílio Coletivo",
    3: "Estab. Agropecuário",
    4: "Estab. Ensino",
    5: "Estab. Saúde",
    6: "Outras Finalidades",
    7: "Em Construção",
    8: "Estab. Religioso",
}
RESIDENCE_LABELS = {101: "Casa", 102: "Casa de Vila/Condomínio", 103: "Apartamento", 104: "Outros"}
METHOD_LABELS = {1: "Medido em campo", 2: "Estimado próximo", 3: "Estimado distante", 4: "Outro método", 6: "Sem medição"}
METHOD_WEIGHTS = {1: 1.0, 2: 0.8, 3: 0.5, 4: 0.3, 6: 0.1}
FIELD_WEIGHTS = {"cep": 1.5, "lograd_num": 1.5, "complemento": 1.0, "dsc_localidade": 0.5, "nv_geo_coord": 0.5}
#: Broad category of a kind; of a land use, by the first rule with a keyword it contains.
CATEGORY_OF_KIND = {1: "Residencial", 2: "Residencial", 3: "Agro", 4: "Institucional", 5: "Institucional", 6: "Comercial", 7: "Outros", 8: "Institucional"}
LAND_USE_RULES = (("Residencial", "RESID|DOMIC"), ("Comercial", "COMERC|SERV|MIST"), ("Institucional", "INST|PUBLI|EDUC|SAUDE"))
CATEGORIES = ("Residencial", "Comercial", "Institucional", "Outros")
VERTICAL_WORDS = "apartamento|edif[ií]cio|condom[ií]nio|bloco|sala|loja|andar|cobertura"
SEARCH_RADIUS, TEXT_THRESHOLD, ALPHA = 100.0, 80.0, 0.5
