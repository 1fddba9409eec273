"""Text expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.split() and str.strip() take for whitespace. Java's Unicode \s lacks the four separators.
SPACE = r"\s\x1C-\x1F"


def strip(text: Column) -> Column:
    """``text`` without leading and trailing Unicode whitespace (``trim`` would take spaces only)."""
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def full_text(title: Column, text: Column) -> Column:
    """``title. text`` stripped; without a title, the text as it is; nulls count as empty."""
    body = F.coalesce(text, F.lit(""))
    head = F.coalesce(title, F.lit(""))
    return F.when(head != "", strip(F.concat(head, F.lit(". "), body))).otherwise(body)


def word_count(text: Column) -> Column:
    """Number of pieces between Unicode whitespace; 0 for null, empty and blank texts."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(rf"(?U)[^{SPACE}]+"), F.lit(0))), F.lit(0))


# Spanish function words that the analyzer drops.
STOPWORDS_ES = (
    "a al algo ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era eres es esa esas ese eso esos esta estas este esto estos "
    "fue fueron ha han hasta hay la las le les lo los me mi mis mucho muy nada ni no nos o os otra otro para pero poco por porque que quien se ser si sin sobre son su sus "
    "también te tiene todo todos tu tus un una uno unos y ya yo él más sí"
).split()

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null, empty and blank texts."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def light_stem_es(word: Column) -> Column:
    """Light stem of a Spanish word: accents of vowels folded, plural and gender endings dropped; short words stay."""
    folded = F.translate(word, "áéíóúü", "aeiouu")
    stem = (
        F.when(F.length(word) < 5, word)
        .when(folded.endswith("eses"), F.regexp_replace(folded, "es$", ""))
        .when(folded.endswith("ces"), F.regexp_replace(folded, "ces$", "z"))
        .when(folded.rlike("(os|as|es)$"), F.regexp_replace(folded, "(os|as|es)$", ""))
        .otherwise(F.regexp_replace(folded, "[oae]$", ""))
    )
    return stem


def analyze_es(text: Column) -> Column:
    """Tokens without stopwords, stemmed."""
    kept = F.filter(tokens(text), lambda w: ~w.isin(STOPWORDS_ES))
    return F.transform(kept, light_stem_es)


def snippet(text: Column, size: int) -> Column:
    """The first ``size`` characters, with three dots if there are more."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def query_prompt(task: str, text: Column) -> Column:
    """The instruction template of prompted query encoders."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), text)
