"""Schemas of the matcher's rows. Missing answers are null or empty; both count as missing."""

from pyspark.sql import types as T

QUESTIONS = T.StructType.fromDDL("doc_id string, idx int, no int, text string, options array<string>, raw string, alt string, alt_options array<string>, stmt boolean")
KEY_ENTRIES = T.StructType.fromDDL("doc_id string, idx int, no int, answer string, text string")
ASSIGNMENTS = T.StructType.fromDDL("match_id string, p_idx int, k_idx int, confidence double, method string")
MARKS = T.StructType.fromDDL("sheet_id string, no int, answer string")
OCR_LINES = T.StructType.fromDDL("page_id string, side string, ord int, text string, y0 double, y1 double")
PDF_ITEMS = T.StructType.fromDDL("page_id string, ord int, str string, x double, y double, width double")
METHODS = ("content", "position", "offset", "same-number", "stem", "rev")
STATES = ("unmatched", "blank", "correct", "wrong")
