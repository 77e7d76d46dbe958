"""Column functions over text: normalisation, tokens, suffixes, markup, labels. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters and digits or any single other character; tokens partition the text.
TOKEN = r"[\p{L}\p{N}]+|(?s:[^\p{L}\p{N}])"

# --- fixed values: the normalisation map, one character for one, and the ranges that become a blank or a dash ---
ONE_FOR_ONE = {
    "\u00a0": " ", "\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'", "\u00ab": '"', "\u00bb": '"', "\u2039": "'", "\u203a": "'", "\u201e": '"',
    "\r": " ", "\t": " ", "\u015f": "\u0219", "\u015e": "\u0218", "\u0162": "\u021a", "\u0163": "\u021b", "\u00c3": "\u0102", "\u00e3": "\u0103", "\u00f8": "o",
}
BLANKS = "[\u2000-\u200e]"
DASHES = "[\u2020-\u2024\u2072-\u2073\u208f\u209d-\u209f\u25a0-\u269f]"
# --- fixed values: suffixes in the order they are tried, and what replaces each ---
SUFFIXES = (("ei", "a"), ("ăi", "a"), ("ilor", "i"), ("ul", ""), ("zii", "da"))
VOID = ("O", "_")


def normalize_chars(text: Column) -> Column:
    """Quotes, blanks, bullets and legacy diacritics to one form."""
    out = F.translate(text, "".join(ONE_FOR_ONE), "".join(ONE_FOR_ONE.values()))
    return F.regexp_replace(F.regexp_replace(out, BLANKS, " "), DASHES, "- ")


def split_initials(text: Column) -> Column:
    """A.B.Name -> A.B. Name"""
    return F.regexp_replace(text, r"((?:[A-Z]\.)+)([A-Z][a-z]+)", "$1 $2")


def space_slashes(text: Column) -> Column:
    """Blanks around a slash between letters."""
    letters = "[a-zA-Z.ăîâșțĂÎÂȘȚ]+"
    return F.regexp_replace(text, f"({letters})/({letters})", "$1 / $2")


def normalize(text: Column) -> Column:
    return space_slashes(split_initials(normalize_chars(text)))


def words(text: Column) -> Column:
    """All tokens of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def char_position(raw: Column, byte: Column) -> Column:
    """Characters before a byte position of UTF-8 bytes, tags and entities of the markup not counted."""
    text = F.decode(F.substring(raw, F.lit(1), byte), "UTF-8")
    return F.length(xml_unescape(F.regexp_replace(text, r"</?[dw][^>]*>", "")))


def strip_markup(text: Column) -> Column:
    """Text of the wrapping markup: paragraphs become lines."""
    out = F.regexp_replace(text, r"</w:t></w:p>(?!</d>)", "\n")
    return xml_unescape(F.regexp_replace(out, r"</?(?:d|w:p|w:t)>", ""))


def detokenize(forms: Column) -> Column:
    """Forms joined by blanks, none before closing and none after opening punctuation."""
    joined = F.array_join(forms, "\u0001")
    joined = F.regexp_replace(joined, "\u0001(?=[:;.,)}\\]](?:\u0001|$))", "")
    joined = F.regexp_replace(joined, "(^|\u0001)([(\\[{])\u0001", "$1$2")
    return F.replace(joined, F.lit("\u0001"), F.lit(" "))


def suffix_of(token: Column) -> Column:
    """The first known suffix of a token of four characters or more, else the empty text."""
    out = F.lit("")
    for suffix, _ in reversed(SUFFIXES):
        out = F.when(F.endswith(token, F.lit(suffix)) & (F.length(token) >= 4), suffix).otherwise(out)
    return out


def stem_of(token: Column) -> Column:
    out = token
    for suffix, instead in reversed(SUFFIXES):
        out = F.when(F.endswith(token, F.lit(suffix)) & (F.length(token) >= 4), F.concat(F.substring(token, F.lit(1), F.length(token) - len(suffix)), F.lit(instead))).otherwise(out)
    return out


def apply_suffix(replacement: Column, suffix: Column) -> Column:
    """The suffix goes to the replacement's first word, whose final a gives way."""
    first, rest = F.regexp_extract(replacement, r"^(\S+)", 1), F.regexp_replace(replacement, r"^\S+", "")
    return F.when(F.coalesce(suffix, F.lit("")) == "", replacement).otherwise(F.concat(F.regexp_replace(first, "a$", ""), suffix, rest))


def entity_type(ent_id: Column) -> Column:
    """#PER6_ei -> PER"""
    return F.regexp_extract(ent_id, "^#([A-Za-z]+)", 1)


def entity_suffix(ent_id: Column) -> Column:
    """#PER6_ei -> ei"""
    return F.regexp_extract(ent_id, "^#[A-Za-z]+[0-9]*_(.*)$", 1)


def plain_id(ent_id: Column) -> Column:
    """#PER6_ei -> #PER6"""
    return F.split_part(ent_id, F.lit("_"), F.lit(1))


def label_type(ner: Column) -> Column:
    """B-PER, I-PER or PER -> PER; void -> null."""
    return F.when(~F.coalesce(ner, F.lit("O")).isin(*VOID), F.regexp_replace(ner, "^[BI]-", ""))


def multiset_key(text: Column) -> Column:
    """Lower-case words in sorted order: word order does not count in dictionaries."""
    return F.array_join(F.array_sort(F.split(F.lower(F.trim(text)), r"\s+")), " ")


def city_variants(name: Column) -> Column:
    """The comma-below and the cedilla spelling of an upper-case name."""
    upper = F.upper(F.trim(name))
    return F.array_distinct(F.array(F.translate(upper, "ŞŢ", "ȘȚ"), F.translate(upper, "ȘȚ", "ŞŢ")))


def stable_number(text: Column) -> Column:
    """32 bits of a text's MD5: the same in any engine, so that splits and draws can be repeated."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def case_of(doc_id: Column) -> Column:
    return F.split_part(doc_id, F.lit("_"), F.lit(1))


def change_extension(name: Column, extension: str) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", f".{extension}")


def file_type(name: Column, kind: Column) -> Column:
    """docx, txt or html as named, docx for anything else; null if a docx does not end in .docx."""
    known = F.when(F.lower(kind).isin("docx", "txt", "html"), F.lower(kind)).otherwise("docx")
    return F.when((known == "docx") & ~F.lower(name).rlike(r"\.docx$"), None).otherwise(known)


def features_to_map(feats: Column) -> Column:
    return F.when(feats == "_", None).otherwise(F.str_to_map(feats, F.lit("\\|"), F.lit("=")))


def map_to_features(m: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.when(m.isNull() | (F.size(m) == 0), "_").otherwise(F.array_join(pairs, "|"))
