"""Canonical complaint schema and fixed values that must equal the reference's.

Fixed values -- kept verbatim so results match: canonical column names, the alias
lists the column mapper scores against, the generic-label spellings, the composite
text parts and the trend words.
"""

from __future__ import annotations

# ---- fixed values (must equal the reference) ---------------------------------
KEY = "NU_REGISTRO"
CATEGORY = "DS_ASSUNTO"
USER = "CD_USUARIO"
SUBCATEGORY = "SUB_ASSUNTO"
TEXT = "DS_OBSERVACAO"
REGISTERED_AT = "DT_REGISTRO_ATENDIMENTO"
BRANCH = "DS_FILIAL"
OPERATOR = "OPERADORA"

REQUIRED_COLUMNS = [KEY, CATEGORY, USER, SUBCATEGORY, TEXT, REGISTERED_AT, BRANCH]

OPTIONAL_TEXT_COLUMNS = ["DS_MOTIVO", "DS_TRATATIVA", "DS_RETORNO"]
DATE_COLUMNS = ["DT_REGISTRO_ATENDIMENTO", "DT_ATRIBUICAO", "DT_CONCLUSAO",
                "DT_LIMITE", "DT_LIMITE_CONCLUSAO", "DT_SAC"]

# Column-mapper targets and their aliases, in the reference's order.
COLUMN_ALIASES = {
    "NU_REGISTRO": ["nu_registro", "nu registro", "numero registro", "numero_registro", "id", "registro"],
    "DS_ASSUNTO": ["ds_assunto", "ds assunto", "assunto", "categoria", "descricao assunto"],
    "CD_USUARIO": ["cd_usuario", "cd usuario", "codigo usuario", "codigo_usuario", "usuario", "user"],
    "SUB_ASSUNTO": ["sub_assunto", "sub assunto", "subassunto", "subcategoria"],
    "DS_OBSERVACAO": ["ds_observacao", "ds observacao", "observacao", "descricao", "texto", "reclamacao"],
    "DT_REGISTRO_ATENDIMENTO": ["dt_registro_atendimento", "dt registro atendimento", "data registro",
                                "data_registro", "dt_registro", "dt registro", "data atendimento",
                                "data_atendimento", "dt_atendimento"],
    "DS_FILIAL": ["ds_filial", "ds filial", "filial", "unidade", "loja"],
    "OPERADORA": ["operadora", "operator", "operador", "empresa", "carrier"],
}
COLUMN_MATCH_THRESHOLD = 70

# Generic ("other") category spellings, compared after strip + upper.
GENERIC_CATEGORIES = ["OUTROS", "OUTRO"]
# Substring that marks a generic sub-category (upper-cased form) / batch form (lower).
GENERIC_SUB_MARK = "OUTRO"
GENERIC_SUB_MARK_LOWER = "outro"

# Parts of the kNN composite text, in order; parts must be longer than 5 characters;
# the joined text is cut at 2000 characters.
COMPOSITE_TEXT_COLUMNS = ["DS_OBSERVACAO", "DS_MOTIVO", "DS_TRATATIVA", "DS_RETORNO", "SUB_ASSUNTO"]
COMPOSITE_MIN_PART = 5
COMPOSITE_MAX_CHARS = 2000
MIN_TEXT_LENGTH = 10
# Parts of the random-forest text, in order, no cut.
FOREST_TEXT_COLUMNS = ["DS_ASSUNTO", "DS_OBSERVACAO", "DS_TRATATIVA", "DS_RETORNO", "DS_MOTIVO"]

# Trend words by sign of the change.
TREND_UP, TREND_DOWN, TREND_FLAT = "AUMENTO", "REDUÇÃO", "ESTÁVEL"
# Label normalisation: upper-case, then these accents replaced, then strip.
ACCENTS_FROM, ACCENTS_TO = "ÉÍÓ", "EIO"

# kNN defaults: k=5, acceptance threshold 0.45 (fast sub-category run: k=3, 0.50).
KNN_K = 5
KNN_THRESHOLD = 0.45
# Thresholds swept by the accuracy report.
ACCURACY_THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]
# Snippets: first 100 characters of the three nearest texts, plus "...".
SNIPPET_COUNT, SNIPPET_CHARS, SNIPPET_SUFFIX = 3, 100, "..."
# ------------------------------------------------------------------------------
