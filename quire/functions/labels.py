"""Label vocabularies and the maps between them. All tables are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Foreign layout taxonomies -> native labels.
TAXONOMIES = {
    "D4LA": {
        "DocTitle": "Headline", "ParaTitle": "Subhead", "RegionTitle": "Subhead", "ParaText": "Paragraph", "ListText": "UnorderedList", "RegionList": "UnorderedList",
        "RegionKV": "Paragraph", "Abstract": "Deck", "Author": "Author", "Date": "Dateline", "Question": "Question", "OtherText": "Paragraph", "Catalog": "TOC",
        "LetterDear": "Paragraph", "LetterSign": "Byline", "Number": "Paragraph", "Equation": "Paragraph", "Reference": "Literature", "LetterHead": "Header",
        "PageHeader": "Header", "Footer": "Footer", "PageFooter": "Footer", "PageNumber": "PageNum", "Figure": "Figure", "FigureName": "Caption", "Table": "Table",
        "TableName": "Caption",
    },
    "DocStructBench": {
        "title": "Headline", "plain text": "Paragraph", "abandon": "Abandon", "figure": "Figure", "figure_caption": "Caption", "table": "Table",
        "table_caption": "Caption", "table_footnote": "Footnote", "isolate_formula": "Paragraph", "formula_caption": "Caption",
    },
    "dotsocr": {
        "Title": "Headline", "Section-header": "Subhead", "Text": "Paragraph", "List-item": "UnorderedList", "Caption": "Caption", "Footnote": "Footnote",
        "Formula": "Paragraph", "Picture": "Figure", "Table": "Table", "Page-header": "Header", "Page-footer": "Footer",
    },
    "mineru": {
        "title": "Headline", "text": "Paragraph", "image": "Figure", "image_caption": "Caption", "image_footnote": "FigByline", "table": "Table",
        "table_caption": "Caption", "table_footnote": "FigByline", "interline_equation": "Paragraph", "isolate_formula": "Paragraph", "list": "UnorderedList",
        "index": "TOC",
    },
}
#: Native labels with an item class of their own; anything else is a Paragraph.
CLASSES = (
    "Header", "Footer", "PageNum", "Section", "Dateline", "EditNote", "MarginNote", "Headline", "Kicker", "Deck", "Subhead", "Subsubhead", "Author", "Byline",
    "Translator", "Paragraph", "Quote", "Dropcap", "Figure", "Caption", "FigByline", "Table", "OrderedList", "UnorderedList", "Footnote", "TOC", "Literary",
    "Literature", "Advertisement", "Question", "Abandon",
)
#: Native labels -> benchmark category types.
BENCHMARK = {
    **dict.fromkeys(("Headline", "Section", "Subhead", "Subsubhead", "Kicker"), "title"),
    **dict.fromkeys(("Deck", "Paragraph", "Quote", "Literary", "Literature", "Dropcap", "Byline", "FigByline", "Author", "Translator", "Dateline", "EditNote", "Question", "OrderedList", "UnorderedList", "TOC"), "text"),
    "Figure": "figure",
    "Caption": "figure_caption",
    **dict.fromkeys(("Header", "Footer", "PageNum", "Footnote", "MarginNote", "Abandon", "Advertisement"), "abandon"),
}
UNKNOWN_TYPE = "text_block"
#: Detector vocabularies -> benchmark category types.
DETECTORS = {
    "DocLayNet": {
        "Caption": "figure_caption", "Footnote": "page_footnote", "Formula": "equation_isolated", "List-item": "text_block", "Page-footer": "footer",
        "Page-header": "header", "Picture": "figure", "Section-header": "title", "Table": "table", "Text": "text_block", "Title": "title",
    },
    "PubLayNet": {"text": "text_block", "title": "title", "list": "text_block", "table": "table", "figure": "figure"},
    "nemotron": {"table": "table", "chart": "figure", "title": "title", "infographic": "figure", "text": "text_block", "header_footer": "header"},
}
#: Labels and category types that have no place in the reading order.
NOT_IN_ORDER = ("Header", "Footer", "PageNum", "Footnote", "MarginNote", "Abandon", "Advertisement", "Figure", "Caption", "Form", "FigByL", "FigByline")
#: Page types -> genres expected on them; other types are not scored.
PAGE_GENRES = {"Article": "članek", "News": "novice", "Interview": "intervju", "Records": "recenzija", "Letters": "pisma", "Quiz": "kviz", "Events": "dogodki", "Images": "slike", "TOC": "kazalo", "Advert": "reklama", "Cover": "naslovnica"}


def lookup(c: Column, table: dict[str, str]) -> Column:
    """table[c], null where c is not in it."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def relabel(label: Column, taxonomy: Column) -> Column:
    """A foreign label in the native vocabulary; unknown taxonomies and labels pass through."""
    out = F.lit(None).cast("string")
    for name, table in TAXONOMIES.items():
        out = F.when(taxonomy == name, lookup(label, table)).otherwise(out)
    return F.coalesce(out, label)


def item_class(label: Column) -> Column:
    return F.when(label.isin(*CLASSES), label).otherwise("Paragraph")


def benchmark_type(label: Column, override: dict[str, str] | None = None) -> Column:
    """Category type of a native label; `override` wins over the default, labels in neither are text blocks."""
    return F.coalesce(lookup(label, {**BENCHMARK, **(override or {})}), F.lit(UNKNOWN_TYPE))


def detector_type(label: Column, vocabulary: str) -> Column:
    """Category type of a detector's label; labels that it does not map pass through."""
    return F.coalesce(lookup(label, DETECTORS[vocabulary]), label)


def in_reading_order(label: Column) -> Column:
    """Neither the label nor its category type is left out of the reading order."""
    return ~(label.isin(*NOT_IN_ORDER) | F.coalesce(lookup(label, BENCHMARK), label).isin(*NOT_IN_ORDER))


def expected_genres(page_type: Column, override: dict[str, str] | None = None) -> Column:
    """Genres that a page of this type should hold, null where it is not scored."""
    genre = lookup(page_type, {**PAGE_GENRES, **(override or {})})
    return F.when(genre.isNotNull(), F.array(genre))
