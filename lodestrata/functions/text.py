"""Text cleaning and metadata extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_RECORD_CHARS = 20
NBSP = " "
# Fixed values that results depend on: folders and their document types, works and what file names call them (the first
# that matches wins), romanization rules in order, monograph headers, divisions, and the patterns of headings and properties.
FOLDERS = {
    "classical_texts": "classical_text", "pharmacopoeia": "pharmacopoeia", "research_papers": "research_paper",
    "regulatory": "regulatory", "clinical": "clinical", "formulations": "formulation",
}
WORKS = (
    ("Charaka Samhita", ("charaka", "caraka")), ("Sushruta Samhita", ("sushruta", "susruta")), ("Ashtanga Hridaya", ("ashtanga_hridaya",)),
    ("Ashtanga Sangraha", ("ashtanga_sangraha",)), ("Madhava Nidana", ("madhava",)), ("Bhavaprakasha", ("bhavaprakasha",)),
    ("Ayurvedic Pharmacopoeia of India", ("api",)), ("Ayurvedic Formulary of India", ("afi",)),
)
ROMANIZED = (("chh", "c"), ("ch", "c"), ("sh", "s"), ("w", "v"), ("aa", "a"), ("ee", "i"), ("oo", "u"), ("ri", "r"))
SECTIONS = (
    "SYNONYMS", "DESCRIPTION", "IDENTITY, PURITY AND STRENGTH", "CONSTITUENTS", "PROPERTIES AND ACTION", "THERAPEUTIC USES",
    "FORMULATIONS", "IMPORTANT FORMULATIONS", "DOSE", "MICROSCOPIC", "MACROSCOPIC",
)
STHANAS = {
    "sutrasthana": "Sutrasthana", "nidanasthana": "Nidanasthana", "vimanasthana": "Vimanasthana", "sharirasthana": "Sharirasthana",
    "sarirasthana": "Sharirasthana", "indriyasthana": "Indriyasthana", "chikitsasthana": "Chikitsasthana", "chikitsitasthana": "Chikitsasthana",
    "kalpasthana": "Kalpasthana", "siddhisthana": "Siddhisthana", "uttaratantra": "Uttaratantra", "uttarasthana": "Uttarasthana",
}
HEADING = r"^[A-Z][A-Z0-9 ,.&()/'-]{2,48}$"
PROPERTIES = {"rasa": "rasa", "guna": "gu[nṇ]a", "virya": "v[iī]rya", "vipaka": "vip[aā]ka", "karma": "karma"}


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, rf"(?U)^\s+|\s+$", "")


def normalize_whitespace(c: Column) -> Column:
    """LF line ends, single spaces, stripped lines, at most one blank line between paragraphs."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"[ \t{NBSP}]+", " ")
    c = F.regexp_replace(c, r"(?Um)^[^\S\n]+|[^\S\n]+$", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def doc_type_of(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    out = F.lit("unknown")
    for folder in reversed(FOLDERS):
        out = F.when(F.array_contains(parts, folder), FOLDERS[folder]).otherwise(out)
    return out


def text_name_of(source: Column) -> Column:
    out = F.lit(None).cast("string")
    for title, words in reversed(WORKS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(source), F.lit(w))
        out = F.when(hit, title).otherwise(out)
    return out


def work_key(label: Column) -> Column:
    """Canonical title: by keyword, else an exact title in any case, else the label in lower case; null is empty."""
    exact = F.lit(None).cast("string")
    for title, _ in WORKS:
        exact = F.when(F.lower(label) == title.lower(), title).otherwise(exact)
    return F.coalesce(text_name_of(label), exact, F.lower(label), F.lit(""))


def romanization_key(token: Column) -> Column:
    out = token
    for old, new in ROMANIZED:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(token.rlike("^[A-Za-z]{3,}$"), out).otherwise(token)


def sanitize_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def roman_to_int(c: Column) -> Column:
    """Right to left, subtracting what is below the largest so far; null unless all letters are numerals and the sum isn't 0."""
    letters = F.regexp_extract_all(F.upper(c), F.lit("."), F.lit(0))
    digits = F.transform(F.reverse(letters), lambda d: F.element_at(F.create_map(*[
        F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair]), d))
    total = F.aggregate(
        digits, F.struct(F.lit(0).alias("total"), F.lit(0).alias("most")),
        lambda acc, v: F.struct((acc["total"] + F.when(v < acc["most"], -v).otherwise(v)).alias("total"), F.greatest(acc["most"], v).alias("most")))["total"]
    return F.when(F.upper(c).rlike("^[IVXLCDM]+$") & (total != 0), total)


def chapter_of(text: Column) -> Column:
    raw = F.regexp_extract(text, r"(?iU)\b(?:chap(?:ter)?|adhyaya)\b\.?\s*([IVXLCDM]{1,7}|\d{1,3})\b", 1)
    return F.when(raw == "", F.lit(None)).when(raw.rlike(r"^\d+$"), raw).otherwise(F.coalesce(roman_to_int(raw).cast("string"), raw))


def sthana_of(text: Column) -> Column:
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)\b([a-z]*sthana|uttaratantra)m?\b"), F.lit(1)), F.lower)
    names = F.create_map(*[F.lit(x) for pair in STHANAS.items() for x in pair])
    return F.get(F.filter(F.transform(tokens, lambda t: F.element_at(names, t)), lambda x: x.isNotNull()), F.lit(0))


def headings(text: Column, limit: int = 5) -> Column:
    return F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.rlike(HEADING)), 1, limit)


def monograph_sections(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.upper(strip(x)))
    return F.array_distinct(F.filter(lines, lambda x: x.isin(*SECTIONS)))


def drug_property(text: Column, name: str) -> Column:
    got = strip(F.regexp_extract(text, rf"(?imU)^\s*{PROPERTIES[name]}\s*[:：]\s*(\S.*?)\s*$", 1))
    return F.when(got != "", got)


def citation(text_name: Column, sthana: Column, chapter: Column, page: Column) -> Column:
    return F.when(text_name.isNotNull(), F.concat_ws(", ", text_name, sthana, F.concat(F.lit("Chapter "), chapter), F.concat(F.lit("p. "), page.cast("string"))))


def fix_glyphs(text: Column, text_name: Column, table: dict[str, str]) -> Column:
    """Letters that fonts of one work show for others; grams that another shows as pounds; soft hyphens and ā elsewhere."""
    between = r"(?U)(?<=[^\W\d_])%s(?=[^\W\d_])"
    letters = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("ƒÊ"), F.lit("µ")), between % "µ", "ñ"), between % "°", "o")
    joined = F.regexp_replace(text, r"(?U)\u00AD\s*", "")
    return (
        F.when(text_name == "Ayurvedic Pharmacopoeia of India", F.translate(letters, "".join(table), "".join(table.values())))
        .when(text_name == "Ayurvedic Formulary of India", F.regexp_replace(text, r"(?U)(?<=\d)(\s*)£", "$1g"))
        .when(text_name.isin("Sushruta Samhita", "Ashtanga Hridaya"), F.regexp_replace(joined, "(?<=[A-Za-z])£|£(?=[a-z])", "ā"))
        .otherwise(text)
    )


def title_case(c: Column) -> Column:
    """Words all in capitals get one capital, one after a bracket too; minor words but the first are in lower case."""
    minor = ("and", "of", "the", "in", "for", "with")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))
    shouted = lambda w: (w == F.upper(w)) & (w != F.lower(w))
    one = lambda w: F.when(shouted(w) & F.startswith(w, F.lit("(")), F.concat(F.lit("("), capital(F.substring(w, 2, 2**31 - 1)))).when(shouted(w), capital(w)).otherwise(w)
    words = F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*minor), F.lower(w)).otherwise(one(w))), " ")


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))


def content_words(text: Column, stop: tuple[str, ...]) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def overlap(part: Column, whole: Column) -> Column:
    """Share of part's words that whole has; 0 if either is empty."""
    return F.when((F.size(part) == 0) | (F.size(whole) == 0), 0.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))
