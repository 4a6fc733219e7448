"""Text scalars as Column expressions: normalising, tokens, counts, labels and ids.

All stay in the JVM.  White space means ``[ \\t\\n\\x0B\\f\\r]`` unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content, of the retrieval tokenizer and of the answer checks.
STOPWORDS = (
    "a an the is in on of to for and or with that this it as at be by from its was are were has have had not but can will just do did so if we "
    "you he she they what how why when where which who"
).split()
ANSWER_STOPWORDS = "a an the is in on of to for and or with that this it as at be by from its was are were has have had not but can will just do".split()
#: Words without content for the keywords of documents, of video captions and of question clusters.
KEYWORD_STOPWORDS = (
    "a about above after again against all also an and any are as at be because been before being below between both but by can did do does doing down "
    "during each few for from further get got had has have having he her here him his how i if in into is it its itself just like more most my "
    "no not now of on once only or other our out over own s same she should so some such than that the their them then there these they this "
    "those through to too under until up us very was we were what when where which while who with you your will would could may might shall its said "
    "one two three four five six seven eight nine ten new use used using make made know see many much well also within without per etc via based across"
).split()
CAPTION_STOPWORDS = (
    "about after again also because before between could during example following from have into like more most only other should that their there these "
    "they this through what when where which while with would"
).split()
TOPIC_STOPWORDS = (
    "the a an is in of and to for with that this are was be it its at by on or from as which have has had can will what how why when where who "
    "not but if so do does did question answer explain find write calculate state define describe list give following marks year part"
).split()

#: Words of difficulty and the level that each names.
DIFFICULTY = {"easy": "easy", "simple": "easy", "basic": "easy", "medium": "medium", "hard": "hard", "difficult": "hard", "advanced": "hard"}

_SPACE = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def collapsed(text: Column) -> Column:
    """Words joined by one space."""
    return F.array_join(words(text), " ")


def tokens(text: Column, stopwords: list[str] | None = None, pattern: str = "[a-zA-Z0-9_]{2,}") -> Column:
    """Lower-case tokens in order, with repeats, without stopwords."""
    stop = STOPWORDS if stopwords is None else stopwords
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def answer_tokens(text: Column) -> Column:
    """Distinct tokens of three letters or more, for comparing an answer with its context."""
    return F.array_distinct(tokens(text, ANSWER_STOPWORDS, "[a-zA-Z0-9_]{3,}"))


def plain_tokens(text: Column) -> Column:
    """Distinct tokens of three letters or digits or more, stopwords included."""
    return F.array_distinct(tokens(text, [], "[a-zA-Z0-9]{3,}"))


def sentences(text: Column) -> Column:
    """Split after . ! or ? before white space; blank ones dropped."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\n\x0B\f\r]+"), lambda s: F.trim(s) != "")


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(n_words(text) * F.lit(1.3)).cast("int"))


def token_estimate_by_chars(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def cleaned(text: Column) -> Column:
    """No NULs, at most one blank line together, no white space at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\x00", ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """Unix line ends, words split at line ends rejoined, single blanks, at most one blank line together."""
    steps = ((r"\r\n?", "\n"), (r"(?<=\w)-\n(?=\w)", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def time_label(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on; fractions are cut off."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    minutes, rest = F.floor(s / 60) % 60, s % 60
    hours = F.floor(s / 3600)
    short = F.concat(F.lpad(minutes.cast("string"), 2, "0"), F.lit(":"), F.lpad(rest.cast("string"), 2, "0"))
    return F.when(hours >= 1, F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), short)).otherwise(short)


def page_label(first: Column, last: Column) -> Column:
    """``a–b``, or the page alone where both are equal or one is missing."""
    a, b = F.coalesce(first, last), F.coalesce(last, first)
    return F.when(a == b, a.cast("string")).when(a.isNotNull(), F.concat(a.cast("string"), F.lit("–"), b.cast("string")))


def video_link(video_id: Column, start: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id, F.lit("&t="), start.cast("long").cast("string"), F.lit("s"))


def video_id(url: Column) -> Column:
    """The 11-character id in a link, or of a bare id; null if there is none."""
    named = F.regexp_extract(url, r"(?:v=|youtu\.be/|embed/|shorts/)([\w-]{11})", 1)
    return F.when(named != "", named).when(F.trim(url).rlike(r"^[\w-]{11}$"), F.trim(url))


def query_hash(query: Column, mode: Column) -> Column:
    """Of the lower-case query with single blanks, and the mode."""
    return F.sha2(F.concat(collapsed(F.lower(query)), F.lit("|"), F.lower(mode)), 256)


def chunk_id(*parts: Column, length: int = 32, separator: str = "::") -> Column:
    """A deterministic id: the head of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws(separator, *[p.cast("string") for p in parts]), 256), 1, length)


def qna_id(source: Column, cluster: Column, text: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", source, cluster.cast("string"), F.substring(text, 1, 100)).cast("binary")), 1, 12)


def lecture_chunk_id(lecture: Column, strategy: Column, window: Column) -> Column:
    return chunk_id(lecture, strategy, window, length=24, separator="|")


def image_chunk_id(index: Column, text: Column) -> Column:
    return chunk_id(index, F.substring(text, 1, 200), length=16, separator=":")


def handwritten_chunk_id(path: Column, index: Column) -> Column:
    return chunk_id(path, F.lit("hw"), index)


def video_chunk_id(video: Column, index: Column) -> Column:
    """Of its video and place, so that a video taken in again keeps its ids."""
    return chunk_id(video, F.lit("yt"), index)


def difficulty(text: Column) -> Column:
    """The level that the first word of difficulty names; null without one."""
    word = F.regexp_extract(F.lower(text), rf"\b({'|'.join(sorted(DIFFICULTY))})\b", 1)
    levels = F.create_map(*[F.lit(x) for pair in DIFFICULTY.items() for x in pair])
    return F.when(word != "", F.element_at(levels, word))


def marks(text: Column) -> Column:
    """The first number in brackets that counts marks, points or pts."""
    found = F.regexp_extract(F.lower(text), r"\[(\d{1,9})\s*(?:marks?|pts?|points?)\]", 1)
    return F.when(found != "", found.cast("int"))


def year(text: Column) -> Column:
    """The last year from 1900 to 2099."""
    found = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int"))


def has_sub_parts(text: Column) -> Column:
    return text.rlike(r"(?m)^\s*\(?[a-d]\)?[.)]\s")


def looks_like_section(text: Column) -> Column:
    """Short, without an end mark, and numbered or named as a section, or up to ten capitalised words."""
    t = F.trim(text)
    named = F.lower(t).rlike(r"^(chapter|unit|section|module|lecture|part|topic|appendix)\b|^\d+(\.\d+)*[.)]?\s+\S")
    capital = (F.upper(t) == t) | ~F.exists(words(t), lambda w: w.rlike(r"^[^A-Z]*[a-z]"))
    return (F.length(t).between(1, 110)) & ~t.rlike(r"[.,;]$") & (named | ((n_words(t) <= 10) & t.rlike("[A-Za-z]") & capital))


def json_object(text: Column) -> Column:
    """The widest {...} within a text, code fences removed; null if there is none."""
    bare = F.regexp_replace(text, r"```[a-zA-Z]*", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def non_empty(column: Column, kind: str) -> Column:
    """Whether a metadata value says anything: not null, and no empty text, array or map."""
    if kind == "string":
        return column.isNotNull() & (column != "")
    if kind.startswith(("array", "map")):
        return column.isNotNull() & (F.size(column) > 0)
    return column.isNotNull()


def index_name(course: Column, prefix: str = "course", most: int = 45) -> Column:
    """A table name for a course: prefix, slug, and the head of a hash, in at most ``most`` characters."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(course), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    room = most - len(prefix) - 10
    cut = F.regexp_replace(F.substring(slug, 1, room), r"-+$", "")
    return F.concat_ws("-", F.lit(prefix), F.when(cut != "", cut), F.substring(F.sha2(course, 256), 1, 8))
