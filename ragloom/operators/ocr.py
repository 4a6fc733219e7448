"""Tables of recognised pages: blocks from words, page texts, escalation, and the decisions on a page's picture.

The pixels themselves are read elsewhere; these operators take words, texts and diagnostics.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least confidence and length of a block, and when a page or a code block is warned of.
LEAST_CONFIDENCE, LEAST_LENGTH, WARN_PAGE, WARN_CODE, ESCALATE = 45, 3, 60, 50, 0.75

# Signs of code, and of each language, the first of equals leading.
CODE_SIGNS = [
    r"[{}()\[\];]", r"\b(def|class|import|for|while|if|else|return|function|var|let|const)\b", r"==|!=|<=|>=|->|=>|:=", r"#include|#define",
    r"\bNULL\b|\bnull\b|\bNone\b|\bundefined\b", r"[a-z_]+\([^)]*\)", r"^\s{2,}",
]
LANGUAGE_SIGNS = {
    "python": [r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+[\s:(]", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r"\bif\s+__name__\s*==", r":\s*$", r"\bprint\s*\(", r"\bself\.", r"->\s*\w+:", r"#.*$"],
    "java": [r"\bpublic\s+(static\s+)?(class|void|int|String)", r"\bprivate\s+\w+\s+\w+", r"\bSystem\.out\.print", r"@Override", r"@Autowired", r"\bnew\s+\w+\s*\(", r"import\s+java\.", r";\s*$"],
    "cpp": [r'#include\s*[<"]', r"\bstd::", r"\bcout\s*<<", r"\bcin\s*>>", r"\busing\s+namespace\s+std", r"\bvoid\s+\w+\s*\(", r"->\w+", r"::\w+"],
    "c": [r'#include\s*[<"]', r"\bprintf\s*\(", r"\bscanf\s*\(", r"\bmalloc\s*\(", r"\bfree\s*\(", r"\bint\s+main\s*\(", r"\*\w+"],
    "javascript": [r"\bconst\s+\w+\s*=", r"\blet\s+\w+\s*=", r"\bvar\s+\w+\s*=", r"\bfunction\s+\w+\s*\(", r"=>\s*\{", r"\bconsole\.log\s*\(", r"===", r"!==", r"\bpromise\b", r"\basync\b", r"\bawait\b", r"document\.", r"window\."],
    "sql": [r"\bSELECT\b.*\bFROM\b", r"\bINSERT\s+INTO\b", r"\bUPDATE\b.*\bSET\b", r"\bDELETE\s+FROM\b", r"\bCREATE\s+(TABLE|DATABASE|INDEX)\b", r"\bWHERE\b", r"\bJOIN\b", r"\bGROUP\s+BY\b"],
    "bash": [r"^\s*#!.*/(bash|sh|zsh)", r"\becho\s+", r"\bexport\s+", r"\$\w+", r"\|\s*\w+", r"chmod\s+", r"sudo\s+", r"&&\s*\n", r"\\\s*\n"],
    "pseudocode": [r"\bBEGIN\b", r"\bEND\b", r"\bIF\b.*\bTHEN\b", r"\bELSE\b", r"\bFOR\b.*\bDO\b", r"\bWHILE\b.*\bDO\b", r"\bRETURN\b", r"\bPRINT\b", r"←", r"\bPROCEDURE\b", r"\bFUNCTION\b"],
}


def count(text: Column, patterns: list[str], flags: str) -> Column:
    return sum((F.regexp_count(text, F.lit(f"(?{flags}){p}")) for p in patterns), F.lit(0))


def needed(parsed: list) -> list[list[str]]:
    """What every match of a parsed pattern holds, in small letters: one at least of each list's texts."""
    out, run = [], ""
    for kind, value in [*parsed, (None, None)]:
        if kind is sre.LITERAL:
            run += chr(value).lower()
            continue
        out, run = [*out, [run]] if run else out, ""
        if kind is sre.SUBPATTERN:
            out += needed(value[-1])
        elif kind is sre.BRANCH and all(each := [needed(b) for b in value[1]]):
            out.append([w for e in each for w in e[0]])
        elif kind is sre.IN and all(k is sre.LITERAL for k, _ in value):
            out.append([chr(v).lower() for _, v in value])
    return out


def signs(own: Column, patterns: list[str], flags: str) -> Column:
    """count() over a struct of a text and the same in small letters: a pattern is sought only in a text that holds its plain characters."""
    found = F.lit(0)
    for p in patterns:
        one = count(own["text"], [p], flags)
        told = [reduce(or_, [F.contains(own["small"], F.lit(w)) for w in words]) for words in needed(sre.parse(p))]
        found = found + (F.when(reduce(and_, told), one).otherwise(0) if told else one)
    return found


def looks_like_code(text: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    made = F.transform(F.array(F.struct(own.alias("text"), F.lower(own).alias("small"))), lambda t: signs(t, CODE_SIGNS, "m") >= 3)
    return F.get(made, F.lit(0))


def code_language(text: Column) -> Column:
    """The language with the most signs, two at least; the earlier in the table wins ties.

    Prose meets few of the patterns (see signs()), and the scores are made once.
    """
    own = F.coalesce(text, F.lit(""))
    scores = lambda t: F.array(*[F.struct(signs(t, p, "im").alias("n"), F.lit(-i).alias("at"), F.lit(lang).alias("lang")) for i, (lang, p) in enumerate(LANGUAGE_SIGNS.items())])
    best = F.transform(F.array(F.struct(own.alias("text"), F.lower(own).alias("small"))), lambda t: F.array_max(scores(t)))
    return F.get(F.transform(best, lambda b: F.when(b["n"] >= 2, b["lang"]).otherwise("unknown")), F.lit(0))


def block_type(text: Column, top: Column, page_height: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    listed = t.rlike(r"^\s*[-•*]\s|^\s*\d+[.)]\s|^\s*[a-zA-Z][.)]\s")
    return (
        F.when(t == "", "unknown").when((top < page_height * 0.15) & (F.length(t) < 120) & ~t.contains("\n"), "heading").when(listed, "list_item")
        .when((top > page_height * 0.85) & (F.length(t) < 200), "caption").when(F.regexp_count(t, F.lit("[∑∫∂∇×÷±√∞αβγδεζηθ=<>]")) >= 2, "formula").otherwise("paragraph")
    )


def blocks(words: DataFrame, page: list[str]) -> DataFrame:
    """Blocks of a page's words (block_num, word_num, text, conf, x, y, w, h): text, box, mean confidence and reading order.

    Words without confidence are left out, and so are blocks under the least confidence or length.
    """
    seen = words.where("conf >= 0 and trim(text) <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda s: s["text"]), " ")
    found = seen.groupBy(*page, "block_num").agg(
        joined.alias("text"), F.avg("conf").alias("confidence"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    from pyspark.sql import Window

    kept = found.where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.length("text") >= LEAST_LENGTH))
    return kept.withColumn("reading_order", F.row_number().over(Window.partitionBy(*page).orderBy("y", "x", "block_num")) - 1)


def pages(found: DataFrame, page: list[str]) -> DataFrame:
    """A page's text in reading order (code fenced), mean confidence and warnings.  Needs text, confidence, reading_order."""
    code = looks_like_code(F.col("text"))
    shown = F.when(code, F.concat(F.lit("[CODE:"), code_language(F.col("text")), F.lit("]\n"), F.col("text"), F.lit("\n[/CODE]"))).otherwise(F.col("text"))
    out = found.withColumn("shown", shown).withColumn("code", code).groupBy(*page).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "shown"))), lambda s: s["shown"]), "\n\n").alias("text"), F.round(F.avg("confidence"), 2).alias("confidence"),
        F.max("code").alias("has_code"), F.min(F.when(F.col("code"), F.col("confidence"))).alias("code_confidence"))
    warnings = F.array_compact(F.array(F.when(F.col("confidence") < WARN_PAGE, "low page confidence"), F.when(F.col("code_confidence") < WARN_CODE, "low code confidence")))
    return out.withColumn("warnings", warnings).drop("code_confidence")


def full_text(found: DataFrame, doc: str, page: str = "page", text: str = "text") -> DataFrame:
    """A document's page texts with page marks; blank pages are skipped."""
    kept = found.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    marked = F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit("]\n"), F.col(text))
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), marked.alias("t")))), lambda s: s["t"]), "\n\n").alias("text"))


def escalated(cheap: DataFrame, better: DataFrame, keys: list[str], threshold: float = ESCALATE) -> DataFrame:
    """Each page's text, confidence and model: the better model's where the cheap one failed or was unsure, if it gave any.

    ``better`` needs rows only for pages that to_escalate() names.
    """
    second = better.select(*keys, F.col("text").alias("__t"), F.col("confidence").alias("__c"))
    joined = cheap.join(second, keys, "left")
    use = unsure(threshold) & F.col("__t").isNotNull()
    return joined.select(*keys, F.when(use, F.col("__t")).otherwise(F.col("text")).alias("text"), F.when(use, F.col("__c")).otherwise(F.col("confidence")).alias("confidence"), F.when(use, "pro").otherwise("flash").alias("model"))


def unsure(threshold: float = ESCALATE) -> Column:
    return F.col("text").isNull() | (F.coalesce("confidence", F.lit(0.0)) < threshold)


def to_escalate(cheap: DataFrame, threshold: float = ESCALATE) -> DataFrame:
    return cheap.where(unsure(threshold))


def model_tag(found: DataFrame, keys: list[str]) -> DataFrame:
    """flash, pro, mixed or unknown, by the models of a chunk's pages."""
    models = F.array_sort(F.collect_set("model"))
    return found.groupBy(*keys).agg(F.when(F.size(models) > 1, "mixed").otherwise(F.coalesce(F.get(models, F.lit(0)), F.lit("unknown"))).alias("model"))


def page_decisions(diagnostics: DataFrame) -> DataFrame:
    """Append image_type, binariser (null: by score) and psm.  Needs brightness, contrast, blur, noise and watermark."""
    b, c, blur, noise = F.col("brightness"), F.col("contrast"), F.col("blur"), F.col("noise")
    kind = (
        F.when((b < 70) & (c > 40), "low_light").when((b > 200) & (c < 35) & (blur > 400), "clean_scan").when((noise == "high") & (c < 50), "noisy_print").when(F.col("watermark"), "watermarked")
        .when((b < 130) & (blur < 80), "photo").when((c < 30) & (b > 90) & (b < 180), "newspaper").otherwise("mixed")
    )
    typed = diagnostics.withColumn("image_type", kind)
    t = F.col("image_type")
    binariser = F.when(t == "newspaper", "sauvola").when((t == "clean_scan") & (c > 60), "otsu").when(t.isin("photo", "low_light"), "adaptive_gauss")
    psm = F.when(t == "form", 6).when((noise == "high") | (blur < 50), 11).when(t.isin("clean_scan", "newspaper"), 4).otherwise(3)
    return typed.withColumn("binariser", binariser).withColumn("psm", psm)


# Letters that recognition confuses, and then fixes of code and of prose, in their order.
CHARACTERS = [("’", "'"), ("“", '"'), ("”", '"'), ("—", "-"), ("–", "-"), ("×", "*"), ("÷", "/"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("•", "-")]
CODE_FIXES = [
    (r"(?<=[a-zA-Z0-9_])\|(?=[a-zA-Z0-9_])", "l"), (r"(?<!\|)\|(?!\|)", "l"), (r"\bO(?=[0-9])", "0"), (r"(?<=[0-9])O\b", "0"), (r"\bl(?=[0-9])", "1"), (r"(?<=[0-9])l\b", "1"),
    (r"rn\b", "m"), (r"\bI(?=[a-z])", "l"), (r"(?<=\s)_(?=\s)", "-"), (r"``", '"'), (r"''", '"'),
]
PROSE_FIXES = [(r"\b([A-Z])\s(?=[a-z])", "$1"), (r"\s{2,}", " "), (r"(?<=[a-z])-\s*\n\s*(?=[a-z])", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]


def clean_text(text: Column, code: bool = False) -> Column:
    """Recognised text with the usual confusions mended; code keeps its indentation, and loses blanks at line ends and blank lines at its ends."""
    for bad, good in CHARACTERS:
        text = F.replace(text, F.lit(bad), F.lit(good))
    for pattern, new in CODE_FIXES if code else PROSE_FIXES:
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\z", "") if code else text


def enriched(pages: DataFrame, enrichments: DataFrame, keys: list[str], threshold: float = WARN_PAGE) -> DataFrame:
    """Pages with their enrichment (text, by page): ``text``, ``used`` (ocr, image, text) and ``warnings``.

    A page under the threshold was read from its picture, others from their text; where the enrichment gave nothing the
    recognised text stays, with a warning.
    """
    given = enrichments.select(*keys, F.col("text").alias("__t"))
    joined = pages.join(given, keys, "left")
    found = F.trim(F.coalesce("__t", F.lit(""))) != ""
    low = F.coalesce("confidence", F.lit(0.0)) < threshold
    return joined.select(
        *keys, F.when(found, F.col("__t")).otherwise(F.col("text")).alias("text"), F.col("confidence"), F.when(~found, "ocr").when(low, "image").otherwise("text").alias("used"),
        F.when(found, F.array().cast("array<string>")).otherwise(F.array(F.lit("enrichment failed"))).alias("warnings"))
