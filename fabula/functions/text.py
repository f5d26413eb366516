"""Text functions as Column expressions; all stay in the JVM.

Letters of "CJK" are U+4E00 to U+9FFF. White space is Unicode's. Null text is an empty text unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"

# English words that no keyword is, lines in capitals that no speaker is, and the patterns of a speaker's
# line, of the marks behind a speaker's name and of a heading.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "to", "of", "for", "in", "on", "at", "by", "with", "from",
    "is", "are", "was", "were", "be", "been", "being", "that", "this", "these", "those", "his", "her",
    "their", "them", "he", "she", "they", "it", "as", "into", "over", "under", "after", "before", "during",
    "while", "through", "about", "because", "when", "then", "than", "very", "more", "most", "just", "still",
]
NO_SPEAKERS = [
    "INT", "EXT", "CUT TO", "CONTINUED", "ANGLE", "LATER", "MORNING", "NIGHT", "DAY",
    "EVENING", "CLOSE", "VOICE", "OMITTED", "MONTAGE", "FADE OUT", "FADE IN", "TITLE",
    "SUPER", "THE END", "MUSIC", "INSERT", "FLASHBACK", "BACK TO SCENE", "WIDE SHOT",
]
SPEAKER_LINE = r"^[A-Z][A-Z .\-']{1,40}$"
SPEAKER_MARKS = r"(?i)\s*\((?:O\.S\.|V\.O\.|OS|VO|CONT'D|OFF)\)\s*"
HEADING = r"(?i)^(?:[A-Z0-9'\" .-]{0,8})?(?:INT\.|EXT\.|INT/EXT\.|I/E\.|EST\.|OMITTED|TITLE:)"


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean_text(c) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def name_key(c) -> Column:
    """The key that names are joined on: lower case, letters a-z, digits and CJK, one space between parts."""
    return F.trim(F.regexp_replace(F.lower(clean_text(c)), rf"[^a-z0-9{CJK}]+", " "))


def match_key(c) -> Column:
    """clean_text in lower case."""
    return F.lower(clean_text(c))


def compact_key(c) -> Column:
    """name_key without spaces."""
    return F.regexp_replace(F.lower(clean_text(c)), rf"[^a-z0-9{CJK}]+", "")


def character_key(c) -> Column:
    """Underscores as spaces, collapsed, lower case."""
    return match_key(F.replace(_text(c), F.lit("_"), F.lit(" ")))


def safe_name(c) -> Column:
    """A name for files: everything but letters, digits, _ and - is _."""
    return F.regexp_replace(_text(c), r"[^\p{L}\p{N}_-]", "_")


def strip_speaker_variant(c) -> Column:
    """A speaker's name without marks such as (V.O.), (O.S.) and (CONT'D)."""
    return clean_text(F.regexp_replace(clean_text(c), SPEAKER_MARKS, " "))


def stable_id(prefix: str, *parts) -> Column:
    """prefix_ and the first 16 hex digits of the MD5 of the parts joined by ||; null parts are empty."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 16))


def tokens(c, language) -> Column:
    """Lower-case tokens: for zh runs of ASCII letters, digits and _ or single CJK letters, and where there are none every letter; else runs of a-z, 0-9 and '."""
    low = F.lower(_text(c))
    chinese = F.regexp_extract_all(low, F.lit(rf"[a-z0-9_]+|[{CJK}]"), 0)
    letters = F.filter(F.split(low, ""), lambda x: F.trim(x) != "")
    return F.when(language == "zh", F.when(F.size(chinese) > 0, chinese).otherwise(letters)).otherwise(F.regexp_extract_all(low, F.lit("[a-z0-9']+"), 0))


def keyword_set(c, language) -> Column:
    """Sorted distinct tokens without stop words; English ones have three letters at least."""
    words = F.array_distinct(tokens(c, language))
    kept = F.filter(words, lambda w: (language == "zh") | (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return F.sort_array(kept)


def feature_tokens(c) -> Column:
    """Distinct runs of a-z, 0-9 and ' of three letters at least, or of CJK letters."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit(rf"[a-z0-9']+|[{CJK}]+"), 0)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) | w.rlike(f"^[{CJK}]")))


def title_case(c) -> Column:
    """Each run of letters with a capital first letter and small ones after it."""
    parts = F.regexp_extract_all(_text(c), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def lines(c) -> Column:
    """The lines of a text, white space at the ends gone, without empty ones."""
    return F.filter(F.transform(F.split(_text(c), r"\R"), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), lambda x: x != "")


def speaker(line: Column) -> Column:
    """The line in capitals that names who speaks, as it stands without marks and points at its ends; null for any other line."""
    bare = F.replace(F.replace(line, F.lit("(O.S.)"), F.lit("")), F.lit("(V.O.)"), F.lit(""))
    bare = F.regexp_replace(bare, r"^[ .:\-]+|[ .:\-]+$", "")
    return F.when(bare.rlike(SPEAKER_LINE) & (F.size(F.split(clean_text(bare), " ")) <= 4), bare)


def speaker_name(found: Column) -> Column:
    return clean_text(F.replace(title_case(found), F.lit(" '"), F.lit("'")))


def speaker_names(c) -> Column:
    """Distinct names of those who speak in a scene, in order."""
    return F.array_distinct(F.transform(F.filter(F.transform(lines(c), speaker), lambda x: x.isNotNull()), speaker_name))


def alias_score(title, content, speakers: Column, aliases: Column) -> Column:
    """How strongly a scene is about a role: of each alias +3 in the title, +3 in the content, +1 if one of its words of three letters or more is in the content, +4 if a speaker has its name, +2 if a speaker's whole name is such a word."""
    head, body = match_key(title), match_key(content)
    names = F.transform(speakers, match_key)
    worth = lambda condition, points: F.when(condition, points).otherwise(0)

    def one(alias: Column) -> Column:
        a = match_key(alias)
        pieces = F.filter(F.split(a, " "), lambda p: F.length(p) >= 3)
        there = worth(F.contains(head, a), 3) + worth(F.contains(body, a), 3) + worth(F.exists(pieces, lambda p: F.contains(body, p)), 1)
        return worth(a != "", there + worth(F.array_contains(names, a), 4) + worth(F.arrays_overlap(names, pieces), 2))

    return F.aggregate(F.transform(aliases, one), F.lit(0), lambda x, y: x + y)


def aliases_of(name, *more) -> Column:
    """A role's names in order, without empty and repeated ones: the name, its first word, others given."""
    n = clean_text(name)
    return F.array_distinct(F.filter(F.concat(F.array(n, F.element_at(F.split(n, " "), 1)), *more), lambda x: x != ""))


def quotes(texts: Column, candidates: Column, most: int) -> Column:
    """Of the candidates, those that are exact parts of the text, distinct, at most `most`."""
    return F.slice(F.array_distinct(F.filter(candidates, lambda q: (q != "") & F.contains(texts, q))), 1, most)


def quote_candidates(c) -> Column:
    """Distinct collapsed lines of 4 to 220 letters."""
    return F.array_distinct(F.filter(F.transform(lines(c), clean_text), lambda x: F.length(x).between(4, 220)))


def excerpt(c, size: int) -> Column:
    return F.substring(_text(c), 1, size)


def joined(*parts, by: str = "\n") -> Column:
    """The parts that aren't empty, joined."""
    return F.concat_ws(by, *(F.when(clean_text(p) != "", p) for p in parts))


def bullets(items: Column) -> Column:
    """A list for a prompt: - and the item on each line, - none where there is none."""
    kept = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: clean_text(x) != "")
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), clean_text(x))), "\n")).otherwise("- none")


def public_scene_id(c) -> Column:
    """Ids of digits count from one in public; others are as they are."""
    x = _text(c)
    return F.when(x.rlike(r"^[0-9]+$"), (x.cast("decimal(38,0)") + 1).cast("string")).otherwise(x)


# How summaries begin that no model wrote.
PLACEHOLDERS = ["Milestone-based timeline for ", "基于 milestone 的"]


def is_placeholder_summary(c) -> Column:
    x = clean_text(c)
    return x.startswith(PLACEHOLDERS[0]) | x.startswith(PLACEHOLDERS[1])


def summary_needs_repair(c, language) -> Column:
    """Whether a summary is empty, a placeholder, or too short or long (zh 20 to 140 letters, else 12 to 110 words)."""
    x = clean_text(c)
    words = F.size(F.split(x, " "))
    size = F.when(language == "zh", ~F.length(x).between(20, 140)).otherwise(~words.between(12, 110))
    return (x == "") | is_placeholder_summary(x) | size


def is_slug_line(c) -> Column:
    """A scene heading inside a scene: six letters or more without points at its ends, mostly capitals, beginning as headings do."""
    x = F.regexp_replace(F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", ""), r"^[ .:\-]+|[ .:\-]+$", "")
    letters, capitals = F.regexp_replace(x, r"[^\p{L}]", ""), F.regexp_replace(x, r"[^\p{Lu}]", "")
    return (F.length(x) >= 6) & (F.length(capitals) > 0.7 * F.length(letters)) & x.rlike(HEADING)
