"""Rule-based routing of questions and clean-up of query variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import word_count

# Words of finance that a question is tested for, as substrings.
KEYWORDS = (
    "revenue", "earnings", "profit", "loss", "margin", "eps", "ebitda", "guidance", "outlook", "quarterly", "annual", "fiscal", "gross", "operating", "net income",
    "cash flow", "dividend", "buyback", "repurchase", "segment", "8-k", "10-k", "sec", "filing", "q1", "q2", "q3", "q4", "fy", "yoy", "qoq",
)
# Beginnings of small talk.
GREETINGS = ("hello", "hi ", "hey ", "thanks", "thank you", "what is your")


def has_keyword(question: Column) -> Column:
    low = F.lower(question)
    return F.exists(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(low, k))


def route(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(qid, intent, confidence, ticker) by rules; null intent where the rules cannot tell.

    A company is found by its ticker or by its name's first word, by equality on the
    words of the question.
    """
    low = F.lower("question")
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(\w+)"), F.lit(1)))
    called = companies.select("ticker", F.explode(F.array(F.lower("ticker"), F.lower(F.substring_index("company", " ", 1)))).alias("w")).groupBy("w").agg(F.min("ticker").alias("ticker"))
    said = questions.select("qid", F.explode(words).alias("w")).join(called, "w").groupBy("qid").agg(F.min("ticker").alias("ticker"))
    hello = F.lit(False)
    for g in GREETINGS:
        hello = hello | low.startswith(g)
    n, kw = word_count(F.col("question")), has_keyword(F.col("question"))
    out = questions.where(F.col("question").isNotNull()).join(said, "qid", "left")
    short, talk, known = (n <= 2) & ~kw, hello & (n < 6), F.col("ticker").isNotNull() & kw
    return out.select(
        "qid",
        F.when(short | talk, "OUT_OF_SCOPE").when(known, "FINANCIAL_SPECIFIC").alias("intent"),
        F.when(short, 0.9).when(talk, 0.95).when(known, 0.92).alias("confidence"),
        F.when(~short & ~talk & known, F.col("ticker")).alias("ticker"),
    )


def flags(routed: DataFrame) -> DataFrame:
    i = F.coalesce("intent", F.lit("AMBIGUOUS"))
    return routed.select("qid", i.alias("intent"), (i != "FINANCIAL_SPECIFIC").alias("skip_hyde"), i.isin("OUT_OF_SCOPE", "GENERAL").alias("skip_transform"), (i == "OUT_OF_SCOPE").alias("refuse"))


def variants(questions: DataFrame, raw: str = "generated", most: int = 3) -> DataFrame:
    """(qid, pos, variant): the question, then up to ``most`` cleaned lines of three words or more that are new."""
    lines = questions.select("qid", "question", F.posexplode(F.split(F.coalesce(raw, F.lit("")), "\n")).alias("at", "line")).where(word_count(F.col("line")) >= 3)
    clean = lines.select("qid", "question", "at", F.trim(F.regexp_replace("line", r"^[0-9.\-) •*]+", "")).alias("variant"))
    new = clean.where(F.lower("variant") != F.lower("question"))
    first = new.withColumn("rn", F.row_number().over(Window.partitionBy("qid", F.lower("variant")).orderBy("at"))).where(F.col("rn") == 1)
    kept = first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("at"))).where(F.col("pos") <= most)
    return questions.select("qid", F.lit(0).alias("pos"), F.col("question").alias("variant")).unionByName(kept.select("qid", "pos", "variant"))


def first_occurrences(rows: DataFrame) -> DataFrame:
    """Variants without repeats, ignoring case and outer blanks; the first stays."""
    w = Window.partitionBy("qid", F.lower(F.trim("variant"))).orderBy("pos")
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def cache_key(question: Column) -> Column:
    return F.sha2(F.lower(F.trim(question)), 256)


_DECISION = "intent STRING, confidence STRING, ticker STRING"


def parse_decision(raw: Column) -> Column:
    """struct(intent, confidence, ticker) of a model's JSON; AMBIGUOUS at 0.5 if it does not parse."""
    d = F.from_json(F.trim(raw), _DECISION)
    known = F.upper(d["intent"]).isin("FINANCIAL_SPECIFIC", "GENERAL", "OUT_OF_SCOPE", "AMBIGUOUS")
    return F.struct(
        F.when(known, F.upper(d["intent"])).otherwise("AMBIGUOUS").alias("intent"),
        F.when(known, F.coalesce(d["confidence"].try_cast("double"), F.lit(0.5))).otherwise(0.5).alias("confidence"),
        F.when(known, d["ticker"]).alias("ticker"),
    )


def transformed(questions: DataFrame, outputs: DataFrame, kinds: tuple[str, ...] = ("hyde", "multi", "stepback")) -> DataFrame:
    """(qid, kind, variant, failed): a technique without output falls back to the question itself."""
    wanted = questions.where(F.trim(F.coalesce("question", F.lit(""))) != "").select("qid", "question", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    out = wanted.join(outputs.select("qid", "kind", "output"), ["qid", "kind"], "left")
    return out.select("qid", "kind", F.coalesce("output", "question").alias("variant"), F.col("output").isNull().alias("failed"))


def stepback(question: Column) -> Column:
    """Default stepped-back variant: the period is left open."""
    return F.regexp_replace(question, r"Q[1-4] \d{4}", "recent quarters")
