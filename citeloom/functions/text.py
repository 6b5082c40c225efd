"""String expressions with the semantics of the document model: Unicode white space, code-point lengths, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as content.
STOP_WORDS = (
    "the a an and or of for to in on at by with from as is are was were be been it its this that these those which what how why "
    "when where who whom can could should would may might will shall do does did not no nor but if then than there here their "
    "them they we you your our us"
).split()


def strip_u(text: Column) -> Column:
    """text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def once(value: Column, body) -> Column:
    """body of value, which is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, "^[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]*", 0)


def content_words(text: Column) -> Column:
    """The distinct content words of a text: runs of three or more of a-z and 0-9, stop words left out."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))


def doc_uid(rel_path: Column) -> Column:
    """16 hex digits of the SHA-1 of a corpus-relative path."""
    return F.substring(F.sha1(F.encode(rel_path, "utf-8")), 1, 16)


def row_id(uid: Column, page: Column, kind: str, index: Column) -> Column:
    """uid:p<page>:<kind><index>; kind is c for chunks and f for figures."""
    return F.format_string(f"%s:p%d:{kind}%d", uid, page, index)


def citation_label(document: Column, page: Column, start: Column, end: Column) -> Column:
    return F.format_string("[%s, Page %d, Line %d-%d]", document, page, start, end)


def image_stem(document: Column) -> Column:
    """A file-name stem of 60 characters at most from a document's name without its last suffix."""
    stem = F.regexp_replace(document, r"(?<=.)\.[^.]*$", "")
    return F.substring(F.regexp_replace(stem, "[^A-Za-z0-9_.-]+", "_"), 1, 60)


def image_name(document: Column, uid: Column, page: Column, index: Column, suffix: Column) -> Column:
    """The file name of an embedded image: stem, eight digits of the document's id, page, place in the document, suffix."""
    return F.concat(image_stem(document), F.format_string("_%s_p%04d_img%03d.", F.substring(uid, 1, 8), page, index), F.lower(suffix))


def without_thinking(text: Column) -> Column:
    """text without <think> blocks; an unclosed block goes to the end, a stray closing tag stays."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for the whole string: * ? [x] [!x]; * crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
            i = close
        else:
            out += c if c.isalnum() or c in "_/ " or ord(c) > 127 else "\\" + c
        i += 1
    return f"(?s)^{out}$"
