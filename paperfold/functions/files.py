"""File names, extensions and routes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperfold.functions.text import extension  # noqa: F401  (re-exported)

# Accepted upload extensions and the file types they stand for.
ALLOWED_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp",
                      ".xlsx", ".xls", ".csv", ".docx")
FILE_TYPES = {
    ".pdf": "application/pdf", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
    ".tiff": "image/tiff", ".tif": "image/tiff", ".bmp": "image/bmp", ".csv": "text/csv",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".html": "text/html", ".htm": "text/html",
}
SHEET_EXTENSIONS = (".xlsx", ".xls", ".csv")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp")


def file_name(url: Column) -> Column:
    """Last path part of a URL, without query and fragment."""
    return F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1)


def file_type(name: Column) -> Column:
    types = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(types, extension(name)), F.lit("application/octet-stream"))


def safe_names(headers: list[str]) -> list[str]:
    """ASCII column names for headers; empty or digit-led ones are numbered, repeats suffixed."""
    taken: list[str] = []
    for i, header in enumerate(headers):
        name = re.sub(r"[^A-Za-z0-9_]", "", re.sub("[ -]", "_", str(header).strip()))
        if not name or name[0].isdigit():
            name = f"field_{i}"
        candidate, n = name, 2
        while candidate in taken:
            candidate, n = f"{name}_{n}", n + 1
        taken.append(candidate)
    return taken


def column_letters(n: int) -> list[str]:
    """A..Z, AA..: spreadsheet column names."""
    out = []
    for i in range(n):
        s, i = "", i + 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        out.append(s)
    return out
