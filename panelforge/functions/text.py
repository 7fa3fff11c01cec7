"""Text functions: cleaning for scoring, ticker detection, symbol cells, lexicon scores."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Upper-case words that bare detection ignores.
BARE_BLOCKLIST = [
    "A", "AN", "THE", "IN", "ON", "AT", "BY", "OF", "TO", "UP", "AS", "IF", "OR", "AND", "BUT", "FOR", "NOR", "SO", "YET",
    "I", "ME", "MY", "WE", "US", "HE", "IT", "ALL", "ANY", "IS", "BE", "DO", "GO", "ARE", "WAS", "HAS", "HAD", "DID", "NOT", "NO", "YES", "OK",
    "DD", "OP", "FD", "IV", "OTM", "ITM", "ATM", "DTE", "ATH", "CEO", "CFO", "CTO", "COO", "IPO", "ETF", "IMO", "TBH", "FOMO", "YOLO", "HODL", "TLDR",
    "WSB", "RH", "SEC", "IRS", "FDA", "FED", "EPS", "PE", "GDP", "CPI", "PPI", "PCE", "YTD", "QTD", "MTD", "TTM", "DCA", "PDT", "AI", "ML", "API",
    "UTC", "EST", "PST", "CST", "AM", "PM", "AH", "LOL", "WTF", "EDIT", "UPDATE", "NEWS", "BTC", "ETH", "NFT", "SPY", "QQQ", "DIA", "VIX",
    "NOW", "KEY", "RE", "IP", "MO", "HI", "LO", "CF", "NI", "WY", "MA", "GS",
    "BREAKING", "DAILY", "WEEKLY", "LIVE", "LONG", "SHORT", "CALL", "PUT", "BULL", "BEAR", "USD", "EUR", "GBP", "JPY",
]

# Disclaimers removed without word boundaries.
BOILERPLATE = [
    "not financial advice", "this is not financial advice", "not a financial advisor", "not an investment advisor", "do your own research",
    "do your own due diligence", "dyor", "nfa", "this is not investment advice", "positions or ban", "edit :", "edit:", "update :", "update:",
    "crossposted from", "cross posted from", "reposting because", "repost",
]

# Patterns of cleaning, in the order they apply (before and after lower-casing).
CASHTAG = r"\$([A-Z]{1,5}(?:[.\-][A-Z]{1,2})?)\b"
BARE = r"(?<!\$)\b([A-Z]{2,5})\b"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E0}-\x{1F1FF}\x{FE00}-\x{FE0F}\x{20D0}-\x{20FF}\x{200B}-\x{200F}\x{2000}-\x{206F}\x{3000}-\x{3004}]+"
BEFORE = [(r"(?m)^>+(?U:\s)?", " "), (r"(?m)^[-*_]{3,}(?U:\s)*$", " "), (r"(?i)/[ur]/(?U:\w)+", " "), (r"(?i)https?://(?U:\S)+|www\.(?U:\S)+|i\.redd\.it/(?U:\S)+|v\.redd\.it/(?U:\S)+", " "), (r"\*{1,2}|_{1,2}|~~|>!|!<", " "), (CASHTAG, "$1"), (EMOJI, " "), (r"[^\x00-\x7F]+", " ")]
AFTER = [("|".join(p.replace(".", r"\.") for p in BOILERPLATE), " "), (r"[^a-z0-9 .,'!\?%\(\)\-]", " "), (r"\s+", " ")]


#: What html.unescape takes for an entity.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def unescape(entities: pd.Series) -> pd.Series:
    """HTML entities to characters, one by one."""
    return entities.map(lambda found: [html.unescape(e) for e in found], na_action="ignore")


def unescaped(text: Column) -> Column:
    """Text with its HTML entities as characters: only the entities go to Python, never the text around them."""
    found = unescape(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    parts = F.zip_with(F.split(text, ENTITY), found, lambda part, e: F.concat(part, F.coalesce(e, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def clean_text(df: DataFrame, text_col: str, out: str = "clean_text", entities: bool = True) -> DataFrame:
    """The cleaning chain in its fixed order; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if entities:  # the entity step has no built-in
        text = unescaped(text)
    for pattern, to in BEFORE:
        text = F.regexp_replace(text, pattern, to)
    text = F.lower(text)
    for pattern, to in AFTER:
        text = F.regexp_replace(text, pattern, to)
    return df.withColumn(out, F.trim(text))


def input_text(title: Column, body: Column) -> Column:
    """'title. body', or the title alone where the body is blank."""
    title, body = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))
    return F.when((body != "") & (title != ""), F.concat(title, F.lit(". "), body)).when(title != "", title).otherwise(body)


def drop_markers(c: Column) -> Column:
    return F.when(F.trim(c).isin("[removed]", "[deleted]", "nan"), F.lit("")).otherwise(c)


def cashtags(text: Column, universe: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1)), lambda s: F.replace(s, F.lit("."), F.lit("-")))
    return F.array_intersect(found, universe)


def bare_symbols(text: Column, universe: Column) -> Column:
    """Upper-case words of 2 to 5 letters that are in the universe and not blocked."""
    valid = F.array_except(F.filter(universe, lambda s: F.length(s) > 1), F.array(*[F.lit(w) for w in BARE_BLOCKLIST]))
    return F.array_intersect(F.regexp_extract_all(text, F.lit(BARE), F.lit(1)), valid)


def detect_tickers(text: Column, universe: Column) -> Column:
    return F.array_sort(F.array_union(cashtags(text, universe), bare_symbols(text, universe)))


def title_cashtags(title: Column) -> Column:
    """The looser variant on upper-cased titles."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(title), F.lit(r"\$([A-Z]{1,5})"), F.lit(1))))


def symbols_cell(c: Column) -> Column:
    """A symbols cell: JSON objects, JSON strings, one object, a Python list, or delimited text."""
    objects = F.from_json(c, "array<struct<symbol:string>>")
    strings = F.from_json(c, "array<string>")
    single = F.from_json(c, "struct<symbol:string>")
    split = F.filter(F.split(F.trim(c), r"[,;\s]+"), lambda s: s != "")
    bracket = F.trim(c).startswith("[")
    parsed = F.when(bracket & c.contains("{"), F.transform(objects, lambda o: o["symbol"])).when(bracket, strings).when(F.trim(c).startswith("{"), F.array(single["symbol"])).otherwise(split)
    return F.when(c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan"), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array().cast("array<string>")))


def python_literal(c: Column) -> Column:
    """A Python dict literal as JSON text; None, True and False stay as they are inside quotes."""
    for old, new in (("None", "null"), ("True", "true"), ("False", "false")):
        # what follows must hold only whole quoted strings; possessive, so long cells need no stack
        rest = r"(?=(?:[^'\"]++|'(?:[^'\\]++|\\.)*+'|\"(?:[^\"\\]++|\\.)*+\")*+$)"
        c = F.regexp_replace(c, rf"(?<=[\[{{:,(\s]){old}(?=\s*[,\]}})]){rest}", new)
    return c


def native_label(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("bullish", "bull", "1", "1.0", "+1", "positive"), "Bullish").when(low.isin("bearish", "bear", "-1", "-1.0", "negative"), "Bearish").otherwise(F.lit(None).cast("string"))


def native_value(c: Column) -> Column:
    return F.when(c == "Bullish", 1.0).when(c == "Bearish", -1.0).otherwise(0.0)


def argmax_label(pos: Column, neg: Column, neu: Column) -> Column:
    """Label of the largest probability; ties take the first of positive, negative, neutral."""
    return F.when((pos >= neg) & (pos >= neu), "positive").when(neg >= neu, "negative").otherwise("neutral")


# Words that turn the next words' sense, words that strengthen or weaken it, and by how much.
NEGATIONS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "cannot", "can't", "don't", "doesn't", "didn't", "won't", "isn't", "aren't", "wasn't", "weren't", "without", "hardly", "rarely", "seldom"]
STRONGER = ["very", "really", "extremely", "absolutely", "completely", "highly", "hugely", "incredibly", "so", "totally", "especially", "most", "more"]
WEAKER = ["almost", "barely", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat"]
BOOST, NEGATED, SHOUT, QUESTION = 0.293, -0.74, 0.292, 0.18
NEAR = [1.0, 0.95, 0.9]  # what a booster one, two, three words ahead counts

# A small finance lexicon; any table of (word, weight) can take its place.
LEXICON = {"gain": 1.0, "gains": 1.0, "beat": 1.0, "strong": 1.0, "growth": 1.0, "up": 0.5, "moon": 1.5, "bullish": 1.5, "loss": -1.0, "losses": -1.0, "miss": -1.0, "weak": -1.0, "down": -0.5, "crash": -1.5, "bearish": -1.5, "fraud": -1.5}


def lexicon_scores(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """Compound score x / sqrt(x^2 + 15) of summed word weights, by a join with (word, weight)."""
    words = df.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), r"[^a-z']+")).alias("word"))
    total = words.join(lexicon, "word").groupBy(id_col).agg(F.sum("weight").alias("x"))
    scored = df.select(id_col).join(total, id_col, "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    return scored.select(id_col, (F.col("x") / F.sqrt(F.col("x") * F.col("x") + 15)).alias("compound"))


def compound_scores(df: DataFrame, text_col: str, lexicon: dict[str, float], out: str = "compound") -> DataFrame:
    """df with a compound score in [-1, 1]: word weights with boosters, negation and punctuation.

    A word counts its weight; a booster up to three words ahead adds or takes BOOST (less
    the further it is); a negation there turns the sum; exclamation marks (four at most)
    add SHOUT each and two or three question marks QUESTION each (0.96 from four on) in the
    direction of the text's sum. The lexicon is a map in the plan, so it should stay in
    the thousands of words; lexicon_scores takes a table of any size.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^a-z']+"), lambda w: w != "")
    weights = F.create_map(*[F.lit(x) for kv in sorted(lexicon.items()) for x in kv])
    any_of = lambda w, names: w.isin(*names)

    def counted(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            base = F.coalesce(F.try_element_at(weights, w), F.lit(0.0))
            before = [F.coalesce(F.get(ws, i - d), F.lit("")) for d in (1, 2, 3)]
            boost = sum((F.when(any_of(b, STRONGER), BOOST * near).when(any_of(b, WEAKER), -BOOST * near).otherwise(0.0) for b, near in zip(before, NEAR, strict=True)), F.lit(0.0))
            strong = base + F.signum(base) * boost
            return F.when(base == 0, 0.0).otherwise(F.when(any_of(before[0], NEGATIONS) | any_of(before[1], NEGATIONS) | any_of(before[2], NEGATIONS), strong * NEGATED).otherwise(strong))

        return F.aggregate(F.transform(ws, one), F.lit(0.0), lambda a, x: a + x)

    marks = lambda c: F.length(text) - F.length(F.translate(text, c, ""))
    questions = F.when(marks("?") >= 4, 0.96).when(marks("?") >= 2, marks("?") * QUESTION).otherwise(0.0)
    loud = F.least(marks("!"), F.lit(4)) * SHOUT + questions
    scored = df.withColumn("cs_words", words).withColumn("cs_sum", counted(F.col("cs_words"))).withColumn("cs_sum", F.col("cs_sum") + F.signum("cs_sum") * loud)
    return scored.withColumn(out, F.col("cs_sum") / F.sqrt(F.col("cs_sum") * F.col("cs_sum") + 15)).drop("cs_words", "cs_sum")


def mentions_any(c: Column, terms: list[str]) -> Column:
    """A cheap test before a costly parse: the text holds one of the terms as a word."""
    return c.rlike("(?<![A-Za-z0-9])(" + "|".join(re.escape(t) for t in sorted(terms)) + ")(?![A-Za-z0-9])")


def scorer_udf(load, batch: int = 32):
    """A pandas UDF around a pluggable model: load() gives texts -> (n, 3) logits, once for each worker. Blank texts are neutral.

    The texts of an Arrow batch go to the model by length, so those of one call are
    about as long as each other; results come in the order of the rows.
    """
    import numpy as np

    @F.pandas_udf("prob_positive double, prob_negative double, prob_neutral double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in parts:
            out = np.tile([0.0, 0.0, 1.0], (len(texts), 1))
            full = np.flatnonzero(texts.fillna("").str.strip() != "")
            full = full[np.argsort(texts.str.len().to_numpy()[full], kind="stable")]
            for at in range(0, len(full), batch):
                rows = full[at : at + batch]
                logits = np.asarray(model(texts.iloc[rows].tolist()), float)
                e = np.exp(logits - logits.max(1, keepdims=True))
                out[rows] = e / e.sum(1, keepdims=True)
            yield pd.DataFrame(out, columns=["prob_positive", "prob_negative", "prob_neutral"])

    return score
