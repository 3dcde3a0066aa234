"""Rows with odd cases."""

LONG = "word " * 30000 + "end"

#: Nulls, empty and long texts, ties, repeated rows, and columns with names the operators use inside.
ROWS = [
    (1, None, "en", 5, "x"), (2, "", "en", 6, None), (3, LONG, "en", 7, "x"),
    (4, "Same text here, twice.", "en", 8, "x"), (5, "same TEXT here, twice.", None, 8, "x"),
    (6, "Row that repeats itself in full.", "de", 9, "y"), (6, "Row that repeats itself in full.", "de", 9, "y"),
    (None, "No id, but a text of some words.", "en", 1, "z"),
    (7, "ÉCOLE é  two  spaces \n\ttabs ▁ sign 🦜", "fr", 2, "z"),
]
SCHEMA = "doc_id long, text string, lang string, n long, norm string"
