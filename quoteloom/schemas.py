"""Schemas of the tables the operators exchange."""

from __future__ import annotations

RECT = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
CELL = "STRUCT<kind: STRING, num: DOUBLE, str: STRING>"
EVIDENCE = (
    "STRUCT<pagina_pdf: INT, ubicacion: STRING, fila_tabla: STRING, columna_tabla: STRING, cita_textual: STRING, "
    "leido_de_figura: BOOLEAN, bloque_id: STRING>"
)
INFERENCE = "STRUCT<columna: STRING, valor: STRING, regla_aplicada: STRING, razonamiento: STRING>"
DISCREPANCY = "STRUCT<columna: STRING, fuente_1: STRING, fuente_2: STRING, valor_adoptado: STRING>"
TRACE_FIELDS = {
    "id_muestra": "STRING",
    "via_de_identificacion": "STRING",
    "estado_del_dato": "MAP<STRING, STRING>",
    "evidencia": f"MAP<STRING, ARRAY<{EVIDENCE}>>",
    "tipo_fiabilidad_desempeno": "STRING",
    "tipo_fiabilidad_felicidad": "STRING",
    "metodo_obtencion_r": "STRING",
    "r_derivado": "DOUBLE",
    "r_imputado_desde_beta": "DOUBLE",
    "tipo_de_efecto": "STRING",
    "tecnica_del_beta": "STRING",
    "sensibilidad_r_cero": "BOOLEAN",
    "conjunto_sugerido": "STRING",
    "motivo_decision_inclusion": "STRING",
    "otros_coeficientes": "ARRAY<STRUCT<descripcion: STRING, valor: STRING, evidencia: STRING>>",
    "mapa_de_efectos": "STRING",
    "inferencias": f"ARRAY<{INFERENCE}>",
    "discrepancias_en_el_articulo": f"ARRAY<{DISCREPANCY}>",
    "advertencias_pendientes": "ARRAY<STRING>",
    "confianza": "STRING",
    "extractor": "STRING",
    "fecha_extraccion": "STRING",
    "verificador": "STRING",
}
TRACE = "STRUCT<" + ", ".join(f"{k}: {v}" for k, v in TRACE_FIELDS.items()) + ">"
CODED_ROWS = (
    f"project_id STRING, extraction_id STRING, doc_id STRING, row_pos INT, fila MAP<STRING, {CELL}>, traz {TRACE}"
)
BLOCKS = (
    f"project_id STRING, doc_id STRING, pos INT, page INT, ord INT, block_id STRING, type STRING, rect {RECT}, "
    "text STRING, text_norm STRING, is_table BOOLEAN, is_image BOOLEAN, grid ARRAY<ARRAY<STRING>>, "
    "cells ARRAY<STRUCT<row: INT, col: INT, text: STRING, row_label: STRING, col_label: STRING>>, image STRING"
)
CONTENT_ITEM = (
    "STRUCT<page_idx: INT, type: STRING, text_level: INT, bbox: ARRAY<DOUBLE>, text: STRING, content: STRING, "
    "list_items: ARRAY<STRING>, table_body: STRING, table_caption: ARRAY<STRING>, table_footnote: ARRAY<STRING>, "
    "image_caption: ARRAY<STRING>, image_footnote: ARRAY<STRING>, chart_caption: ARRAY<STRING>, "
    "chart_footnote: ARRAY<STRING>, img_path: STRING>"
)
MIDDLE = "STRUCT<pdf_info: ARRAY<STRUCT<page_idx: INT, page_size: ARRAY<DOUBLE>>>, _backend: STRING>"
COLUMNS = (
    "project_id STRING, key STRING, header STRING, letter STRING, position INT, data_type STRING, required BOOLEAN, "
    "allowed ARRAY<STRING>, needs_evidence BOOLEAN, level STRING, is_numeric BOOLEAN"
)
FINDINGS = (
    "project_id STRING, extraction_id STRING, finding_no INT, study BIGINT, column STRING, auditor STRING, "
    "verdict STRING, detail STRING, proposed STRING, resolution STRING, state STRING"
)
LOG = "t TIMESTAMP, nivel STRING, origen STRING, mensaje STRING"
EVENT = "id BIGINT, project_id STRING, name STRING, data STRING, attempts INT, error STRING"
