"""Codes, orders and tables that results must reproduce as they are."""

from __future__ import annotations

# --- fixed values: anchor levels, best to worst, and the review state each one opens with
ANCHOR_LEVELS = ["VERIFICADA", "VERIFICADA_CON_CORRECCION", "POR_CONFIRMAR", "NO_VERIFICABLE"]
STATE_BY_LEVEL = {
    "VERIFICADA": "PENDIENTE",
    "VERIFICADA_CON_CORRECCION": "PENDIENTE",
    "POR_CONFIRMAR": "POR_CONFIRMAR",
    "NO_VERIFICABLE": "NO_VERIFICABLE",
}
FUZZY_THRESHOLD = 95.0
LABEL_THRESHOLD = 90.0

# --- fixed values: missing-data codes and numeric column types
NOT_STATED = "No indica"
NOT_STATED_NS = "No indica (no significativo)"
NOT_APPLICABLE = "No aplica"
MISSING_CODES = [NOT_STATED, NOT_STATED_NS, NOT_APPLICABLE]
NUMERIC_TYPES = ["entero", "entero o null", "número o null"]
MULTI_CATEGORY = "categoría múltiple"

# --- fixed values: block types and the converter item types mapped to them ("text" depends on text_level)
BLOCK_TYPES = ["titulo", "parrafo", "tabla", "figura", "ecuacion", "leyenda", "nota", "otro"]
BLOCK_TYPE_BY_ITEM = {
    "table": "tabla",
    "image": "figura",
    "chart": "figura",
    "equation": "ecuacion",
    "interline_equation": "ecuacion",
    "page_footnote": "nota",
    "header": "otro",
    "footer": "otro",
    "page_number": "otro",
    "aside_text": "otro",
    "code": "parrafo",
    "list": "parrafo",
    "ref_text": "parrafo",
}
BBOX_SCALE = 1000.0

# --- fixed values: column keys the rules name
STUDY = "Estudio"
DOCUMENT = "Documento"
R_COL = "Correlación Feli 1 - JP"
BETA_COL = "Beta Fel 1- JP"
COVIDENCE = "Covidence #"
INCLUDE = "Incluir en meta análisi"
REL_PERF = "Fiabilidad Alfa - Omega (desempeño)"
REL_HAPPY = "Fiabilidad Alfa - Omega (felicidad)"
TRANSCRIPT = "Correlacion o Beta felicidad 1 - JP"
NUMERIC_RULE_KEYS = [COVIDENCE, REL_PERF, "# Ítems", "Items instrumento1", REL_HAPPY, "Muestra", R_COL, BETA_COL]
SAMPLE_CONSTANT_KEYS = ["Pais", "Población", "Study design", "Start date", "End date"]
WORKING_NOTE_PATTERN = r"(?i)revisar|preguntar|no es claro|pendiente|\?\?"
NUMBER_PATTERN = r"-?\d*[.,]\d+|-?\d+"
CITATION_PATTERN = r"^(.+?)(?: y (.+?)| et al\.)? \((\d{4})[a-z]?\)$"
BLOCK_ID_PATTERN = r"p\d{2,}-b\d{2,}"

# --- fixed values: critical fields of the double coding
CRITICAL_ROW_FIELDS = [
    "Muestra", R_COL, BETA_COL, REL_PERF, REL_HAPPY, "# Ítems", "Items instrumento1", "Desempeño",
    "Hedónica/eudaimónica", "Tipo de felicidad real", "How measure the employee perfomance", "Study design", "Nivel",
    "Analysis method (principal)", "Direccionalidad de la relación", INCLUDE,
]
CRITICAL_TRACE_FIELDS = [
    "metodo_obtencion_r", "tipo_de_efecto", "tecnica_del_beta", "tipo_fiabilidad_desempeno", "tipo_fiabilidad_felicidad",
]
ROW_COUNT_FIELD = "número de filas"
VALUE_TOLERANCE = 0.001
AGREEMENT_THRESHOLD = 0.80

# --- fixed values: article states, legal moves, and the groups that decide queueing
ARTICLE_STATES = ["HEREDADO", "NUEVO", "CONVIRTIENDO", "LISTO", "EN_COLA", "EXTRAYENDO", "AUDITANDO", "POR_REVISAR",
                  "APROBADO", "ERROR", "EXCLUIDO"]
ARTICLE_MOVES = {
    "NUEVO": ["CONVIRTIENDO"],
    "CONVIRTIENDO": ["LISTO"],
    "LISTO": ["EN_COLA"],
    "EN_COLA": ["EXTRAYENDO", "LISTO", "HEREDADO"],
    "EXTRAYENDO": ["AUDITANDO"],
    "AUDITANDO": ["POR_REVISAR"],
    "POR_REVISAR": ["APROBADO", "EN_COLA"],
    "APROBADO": ["EN_COLA"],
    "HEREDADO": ["EN_COLA"],
    "EXCLUIDO": ["NUEVO", "HEREDADO"],
}
EXCLUDABLE = ["NUEVO", "LISTO", "HEREDADO", "ERROR"]
QUEUEABLE = ["NUEVO", "CONVIRTIENDO", "LISTO", "HEREDADO", "ERROR", "POR_REVISAR"]
INTERMEDIATE = ["CONVIRTIENDO", "EN_COLA", "EXTRAYENDO", "AUDITANDO"]
IDLE_SECONDS = 30 * 60
RECENT_MINUTES = 15

# --- fixed values: review
NEEDS_REASON_TO_APPROVE = ["NO_VERIFICABLE", "POR_CONFIRMAR", "SIN_EVIDENCIA"]
REVIEWED = ["APROBADA", "CORREGIDA"]
MARK_PRIORITY = {"rojo": 0, "naranja": 1, "amarillo-borde": 2, "amarillo": 3, "ninguno": 4, "gris": 5, "verde": 6}

# --- fixed values: audit labels, roles, log levels, usage
AUDITOR_LABELS = {"AUDITOR_EVIDENCIA": "Auditor de evidencia", "CODIFICADOR_CIEGO": "Codificador ciego",
                  "CONCILIADOR": "Conciliador"}
ROLES = ["extractor", "auditor", "ciego", "conciliador"]
LOG_RANK = {"INFO": 0, "WARNING": 1, "ERROR": 2, "CRITICAL": 3}
LOG_OPEN_TAIL = 300
LOG_BATCH = 500
TOKENS_PER_ARTICLE_FALLBACK = 587_719
MAX_DELIVERY_ATTEMPTS = 5
OUTBOX_BATCH = 50
QUOTA_MARKERS = ["usage limit", "limit reached", "hit your limit", "rate limit", "credit balance", "out of credits",
                 "out of extra usage", "insufficient credits", "quota", "límite de uso"]

# --- fixed values: routing by document complexity
LIGHT_MAX_CHARS = 300_000
LIGHT_MAX_TABLES = 4
COMPLEX_DESIGN_PATTERN = (
    r"(?i)structural equation|\bSEM\b|\blatent\b|multilevel|\bHLM\b|mediat|moderat|\bstudy\s*2\b|\bsample\s*2\b"
    r"|longitudinal|\bwave\s*2\b|\btime\s*2\b"
)

# --- fixed values: codebook structure
CODEBOOK_SECTIONS = ["columnas", "esquema_de_salida", "vocabularios_controlados", "validaciones_automaticas"]
COLUMN_FIELDS = ["posicion", "letra_excel", "encabezado_original", "descripcion", "instruccion_operativa"]
GENERAL_TRACE_FIELDS = ["evidencia", "inferencias", "discrepancias_en_el_articulo", "advertencias_pendientes",
                        "mapa_de_efectos", "estado_del_dato", "confianza", "extractor", "fecha_extraccion", "verificador",
                        "id_muestra"]
EXAMPLE_LIMIT = 217
FINAL_NOTE = ("Nota: el registro de trazabilidad es la hoja Trazabilidad que genera la skill "
              "(página, ubicación y cita de cada dato).")
