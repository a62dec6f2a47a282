"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_]+"
#: Headline categories and their Markdown, line by line.
MARKDOWN = {"Headline": ("# ", ""), "Kicker": ("*", "*"), "Author": ("*", "*"), "Byline": ("*", "*"), "Translator": ("*", "*"), "Deck": ("**", "**"), "Subhead": ("## ", ""), "Subsubhead": ("### ", ""), "Quote": ("> ", ""), "Caption": ("*", "*"), "FigByline": ("*", "*"), "Footnote": ("[^note]: ", ""), "TOC": ("*Contents:* ", ""), "Dateline": ("_", "_"), "Section": ("_", "_"), "EditNote": ("_", "_"), "MarginNote": ("_", "_"), "Question": ("**Q:** ", "")}
OMITTED = ("Abandon", "Advertisement", "Header", "Footer", "PageNum")


def normalize_text(t: Column) -> Column:
    """Drop zero-width and soft hyphens, fold Unicode spaces, mend hyphenated line ends, newlines to spaces, collapse, strip."""
    t = F.regexp_replace(t, "[\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}]", "")
    t = F.regexp_replace(t, "[\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]", " ")
    wrap, word = "[ \\t]*\\r?\\n[ \\t]*", "[\\p{L}\\p{N}_]"
    t = F.regexp_replace(t, f"\\x{{ad}}{wrap}", "")
    t = F.regexp_replace(t, "\\x{ad}", "")
    t = F.regexp_replace(t, f"[\\x{{2010}}\\x{{2011}}]({wrap})", "-$1")
    # A dash stays, a hyphen goes before a small letter and stays before any other; one pass, as each match takes both letters.
    t = F.regexp_replace(t, f"({word})(?:([\\x{{2012}}-\\x{{2015}}]){wrap}({word})|-{wrap}(\\p{{Ll}})|(-){wrap}({word}))", "$1$2$3$4$5$6")
    t = F.regexp_replace(t, "\\s*\\r?\\n\\s*", " ")
    return F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "^\\s+|\\s+$", "")


def ends_sentence(t: Column) -> Column:
    return t.rlike("[.!?\\x{2026}\\x{3002}][\"')\\]\\x{bb}\\x{201d}\\x{2019}]*\\s*$")


def is_continuation(t: Column) -> Column:
    return t.rlike("^\\s*[\\p{Ll}\\p{Nd},;)\\x{2013}-]")


def should_merge(prev: Column, cur: Column) -> Column:
    blank = lambda t: F.trim(t) == ""
    return ~blank(prev) & ~blank(cur) & ~ends_sentence(prev) & is_continuation(cur)


def header_tokens(t: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(f"({WORD})"), 1), lambda w: F.length(w) > 2))


def header_similarity(a: Column, b: Column) -> Column:
    x, y = header_tokens(a), header_tokens(b)
    low = F.least(F.size(x), F.size(y))
    return F.when(low > 0, F.size(F.array_intersect(x, y)) / low).otherwise(0.0)


def answer_tokens(t: Column) -> Column:
    """Lower case without punctuation and articles, as tokens."""
    bare = F.regexp_replace(F.lower(t), "[\\p{P}$+<=>^`|~]", "")
    return F.filter(F.split(bare, "[ \\t\\n\\r\\x0b\\x0c]+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))


def markdown_line(category: Column, text: Column) -> Column:
    """Markdown of one item; null for categories that are left out."""
    out = F.when(category.isin(*OMITTED), F.lit(None).cast("string"))
    for c, (a, b) in MARKDOWN.items():
        out = out.when(category == c, F.concat(F.lit(a), text, F.lit(b)))
    return out.otherwise(text)


#: Letters that stand for several.
LIGATURES = {"ß": "ss", "ĳ": "ij", "ŉ": "ʼn", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _letters() -> tuple[str, str]:
    """Small letters with marks (Latin, Greek, Cyrillic and others), and what is left of them without, by Unicode's
    compatibility decomposition."""
    src, dst = [], []
    for cp in range(0xAA, 0x2000):
        c = chr(cp)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.casefold() and bare != c and len(bare) == 1 and bare.isalpha():
            src.append(c)
            dst.append(bare.lower())
    return "".join(src), "".join(dst)


def fold(t: Column) -> Column:
    """Lower case without combining marks; letters with marks fold over all alphabets below U+2000, ligatures fall apart."""
    src, dst = _letters()
    low = F.lower(t)
    for one, many in LIGATURES.items():
        low = F.replace(low, F.lit(one), F.lit(many))
    folded = F.regexp_replace(F.translate(low, src + "\u03c2", dst + "\u03c3"), "\\p{Mn}", "")
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(folded)  # plain ASCII has nothing to fold but its case


def squash(t: Column) -> Column:
    return F.regexp_replace(fold(t), "[^a-z0-9]", "")


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(f"({WORD})"), 1)


def title_key(t: Column) -> Column:
    return F.array_join(words(F.lower(t)), " ")


def is_running_header(t: Column, most: int = 8) -> Column:
    return F.size(words(t)).between(1, most)


def clean_header(t: Column) -> Column:
    """Tokens in capitals only; where there are none, the trimmed text."""
    caps = F.array_join(F.filter(F.split(t, "[ \\t]+"), lambda w: w.rlike("\\p{Lu}") & ~w.rlike("\\p{Ll}")), " ")
    return F.when(caps != "", caps).otherwise(F.trim(t))


def titles_a_piece(t: Column) -> Column:
    """A heading that names a piece: not blank, no trailing colon, not enumerated."""
    return (F.trim(t) != "") & ~t.rlike(":[ \\t]*$") & ~t.rlike("^[ \\t]*\\(?[0-9]{1,2}[ \\t]*[.)]")


def piece_title(t: Column) -> Column:
    return F.when(titles_a_piece(t), F.trim(F.regexp_replace(t, "[ \\t]+", " ")))


#: Inflection endings, longest first; what is left keeps at least five letters.
ENDINGS = ("jema", "jevi", "jeva", "jevo", "jem", "jev", "jih", "jem", "oma", "ama", "ega", "emu", "ovi", "ova", "ovo", "ov", "om", "em", "ju", "ja", "je", "mi", "ih", "ah", "am", "u", "a", "e", "i", "o")
STEM = f"^(.{{5,}}?)(?:{'|'.join(dict.fromkeys(ENDINGS))})$"


def entity_key(t: Column) -> Column:
    """Folded words, each without its ending; empty where nothing is left."""
    parts = F.filter(F.split(F.regexp_replace(fold(t), "[^\\p{L}\\p{N}_]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.regexp_replace(w, STEM, "$1")), " ")


def entity_keys(t: Column, label: Column) -> Column:
    """The key and, for persons (or without a label) of several words, the last word alone."""
    person = F.upper(F.coalesce(label, F.lit(""))).isin("", "PER")

    def keys(key: Column) -> Column:
        alone = F.when(key.contains(" ") & person, F.element_at(F.split(key, " "), -1))
        return F.array_distinct(F.array_compact(F.array(F.when(key != "", key), alone)))

    return F.get(F.transform(F.array(entity_key(t)), keys), 0)  # the key is worked out once


def natural_key(t: Column) -> Column:
    """Sorts runs of digits by value: they are padded, the rest is in lower case."""
    runs = F.regexp_extract_all(t, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(F.lower(r))), "")


#: Labels whose line breaks mean something.
STRUCTURED = ("Table", "OrderedList", "UnorderedList")
#: Words in a folded section header, and the genre of the pieces under it; the longest word found decides.
GENRES = {
    "telegrami": "novice", "odmevi": "novice", "od vsepovsod": "novice", "novice": "novice", "mine iz tujih": "recenzija", "plosce": "recenzija", "izdaje": "recenzija",
    "recenzij": "recenzija", "pisma": "pisma", "krizanka": "kviz", "uganka": "kviz", "kviz": "kviz", "beseda urednistva": "članek", "uvodnik": "članek",
    "reportaza": "članek", "intervju": "intervju", "pogovor": "intervju", "iz vsebine": "kazalo", "kazalo": "kazalo", "naslovnica": "naslovnica", "oglas": "reklama",
    "reklama": "reklama",
}
#: Sections that run as columns of short pieces.
COLUMN_SECTIONS = ("telegrami", "odmevi", "novice", "od vsepovsod", "pisma", "plosce", "izdaje", "mine iz tujih", "iz vsebine")
#: Genres that a classifier may answer.
CLASSES = ("reklama", "članek", "naslovnica", "dogodki", "slike", "intervju", "pisma", "novice", "kviz", "recenzija", "kazalo")


def region_text(label: Column, t: Column) -> Column:
    """Normalised, but for labels whose line breaks mean something."""
    return F.when(label.isin(*STRUCTURED), t).otherwise(normalize_text(t))


def join_halves(a: Column, b: Column) -> Column:
    """Two parts of a paragraph: a word broken at a hyphen is closed up, else one space stands between."""
    left, right = F.regexp_replace(a, "\\s+$", ""), F.regexp_replace(b, "^\\s+", "")
    broken = left.endswith("-") & right.rlike("^\\p{Ll}")
    return F.when(broken, F.concat(F.regexp_replace(left, "-$", ""), right)).otherwise(F.concat(left, F.lit(" "), right))


def longest_contained(t: Column, words: dict[str, str]) -> Column:
    """Value of the longest key that t contains (equally long ones: in order of the dict); null where there is none."""
    out = F.lit(None).cast("string")
    for k in reversed(sorted(words, key=len, reverse=True)):
        out = F.when(t.contains(k), F.lit(words[k])).otherwise(out)
    return out


def section_genre(section: Column) -> Column:
    return longest_contained(fold(section), GENRES)


def is_column_section(section: Column) -> Column:
    t = fold(section)
    out = F.lit(False)
    for k in COLUMN_SECTIONS:
        out = out | t.contains(k)
    return out


def reply_label(reply: Column, classes: tuple[str, ...] = CLASSES) -> Column:
    """The longest class name that occurs as whole words in a model's folded reply."""
    import re

    t, out = fold(reply), F.lit(None).cast("string")
    for c in reversed(sorted(classes, key=len, reverse=True)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        out = F.when(t.rlike(f"(^|[^\\p{{L}}\\p{{N}}_]){re.escape(bare)}($|[^\\p{{L}}\\p{{N}}_])"), F.lit(c)).otherwise(out)
    return out


def strip_fence(t: Column) -> Column:
    """A model's reply without the Markdown fence around it."""
    opened = F.regexp_replace(t, "^\\s*```markdown\\s*", "")
    return F.regexp_replace(opened, "\\s*```\\s*$", "")


def blocks_markdown(contents: Column) -> Column:
    """Non-empty blocks joined by blank lines."""
    return F.array_join(F.filter(contents, lambda c: F.coalesce(c, F.lit("")) != ""), "\n\n")


def is_letter(c: Column) -> Column:
    return c.rlike("^[A-Za-z]$")


def is_numeric(c: Column) -> Column:
    return c.rlike("^\\p{Nd}+$")


def is_soft_punctuation(c: Column) -> Column:
    """A mark after which a line goes on."""
    return c.isin(",", "，", "、", ";", "；", ":", "：", "-", "'", '"', "“")


def stub(id_: Column, prefix: str = "__B") -> Column:
    return F.concat(F.lit(prefix), id_.cast("string"), F.lit("__"))


def stem_of(name: Column) -> Column:
    """A file name without its extension."""
    return F.regexp_replace(name, "[.][^./]+$", "")


def page_of(name: Column) -> Column:
    """struct(stem, page) of <stem>_<page>.<ext>; names without a page number are page 0 of their whole stem."""
    parts = "^(.*)_([0-9]+)$"
    s = stem_of(name)
    return F.when(s.rlike(parts), F.struct(F.regexp_extract(s, parts, 1).alias("stem"), F.regexp_extract(s, parts, 2).cast("int").alias("page"))).otherwise(F.struct(s.alias("stem"), F.lit(0).alias("page")))


def yaml_map(m: Column, indent: int = 2) -> Column:
    """A string map as lines of YAML, by key."""
    rows = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit(" " * indent), e["key"], F.lit(": "), e["value"]))
    return F.array_join(rows, "\n")


def class_prompt(classes: tuple[str, ...] = CLASSES) -> str:
    """What a generative classifier is asked."""
    return "Answer with one of these classes and nothing else: " + ", ".join(classes) + "."
