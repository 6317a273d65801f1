"""What a page record says about itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

# Fixed values that results depend on: letters that the fonts of the pharmacopoeia show for others.
PHARMACOPOEIA_LETTERS = {
    "¡": "ā", "À": "ṣ", "¸": "ṇ", "¢": "ī", "£": "ū", "¶": "ṭ", "á": "Ś", "¤": "ṛ", "¿": "ś", "·": "ḍ", "´": "ṅ", "Æ": "ṃ", "Å": "ḥ", "®": "e",
    "Ë": "Ā", "Ì": "Ī", "â": "Ṣ", "Í": "Ū", "Û": "Ṇ", "Ù": "Ṭ", "Ú": "Ḍ", "×": "Ṅ", "Î": "Ṛ", "Ø": "Ñ", "ê": "Ṃ", "é": "Ḥ", "Ó": "E", "½": "l",
}


def repair(records: DataFrame) -> DataFrame:
    return records.withColumn("text", T.fix_glyphs(F.col("text"), T.text_name_of(F.col("source")), PHARMACOPOEIA_LETTERS))


def enrich(records: DataFrame) -> DataFrame:
    """text_name, heading_path, sthana, chapter, is_monograph, monograph_sections, the properties, and the citation."""
    text, kind = F.col("text"), F.col("doc_type")
    classical, monograph = kind == "classical_text", kind.isin("pharmacopoeia", "formulation")
    sections = T.monograph_sections(text)
    named = records.withColumns({
        "text_name": T.text_name_of(F.col("source")),
        "heading_path": T.headings(text),
        "sthana": F.when(classical, T.sthana_of(text)),
        "chapter": F.when(classical, T.chapter_of(text)),
        "monograph_sections": F.when(monograph, sections),
        "is_monograph": monograph & (F.size(sections) > 0),
        **{p: F.when(monograph, T.drug_property(text, p)) for p in T.PROPERTIES},
    })
    return named.withColumn("citation", T.citation(F.col("text_name"), F.col("sthana"), F.col("chapter"), F.col("page")))
