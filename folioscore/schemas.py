"""Declared schemas (DDL) of the tables the operators exchange."""

VARIANTS = "filestem string, parser string, model string, file string, ord int, text string"
METRIC_ROWS = "Metric string, File1 string, File2 string, Value double"
UNITS = "doc_id string, page_no int, page_text string"
PAGE_RESULTS = (
    "doc_id string, page_no int, markdown string, status string, error string, attempts int"
)
CHUNKS = "doc_id string, page_no int, seq int, delta string"
ELEMENTS = "doc_id string, seq int, kind string, text string, metadata map<string,string>"
LAYOUT_BLOCKS = (
    "doc_id string, page_no int, seq int, kind string, row_no bigint, col_no int, text string"
)
