"""Quantities in different units brought to the common unit of their metric.

A number and a unit expression are read by a small grammar.  A unit is a vector of
dimension exponents with a scale and an offset; units are multiplied by adding
their vectors ("kilowatt hours"), divided ("per", "/") by subtracting them and
raised ("square", "m²", "^3") by multiplying them.  The common unit of a metric is
read by the same grammar, and an amount is taken only where the dimensions agree.
Defined results: a null, blank or wordy property states no
amount; a record whose metric is unknown gives no row; an amount beyond 64 bits
gives none either; repeated rows give repeated results; columns not named here
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.text import fold

# Words of scale and of unit in en, de, fr and es.
SCALES = {
    Decimal(1): ("units", "unit", "single", "ones"),
    Decimal(100): ("hundred", "hundreds"),
    Decimal(10) ** 3: ("k", "thousand", "thousands", "tsd", "tausend", "mille", "milliers", "mil", "miles", "th"),
    Decimal(10) ** 6: ("m", "mm", "mn", "mln", "mio", "million", "millions", "millionen", "millones", "millon", "millón"),
    Decimal(10) ** 9: ("b", "bn", "bln", "mrd", "billion", "billions", "milliarde", "milliarden", "milliard", "milliards"),
    Decimal(10) ** 12: ("tn", "trn", "trillion", "trillions"),
}
#: Scale words that are written with a decimal comma.
COMMA_WORDS = {"tsd", "tausend", "mille", "milliers", "mio", "mrd", "millionen", "milliarde", "milliarden", "milliard", "milliards", "millones", "millon", "millón", "dolares", "dólares"}
#: Dimensions in the order of the exponent vectors; each has its base: dollar, share, kilogram, metre, second, kelvin, one.
DIMENSIONS = ("money", "share", "mass", "length", "time", "temperature", "count")
Vector = tuple[int, ...]
_V = lambda **e: tuple(e.get(d, 0) for d in DIMENSIONS)
NONE, MONEY, SHARE, COUNT = _V(), _V(money=1), _V(share=1), _V(count=1)
MASS, LENGTH, AREA, TIME, HEAT = _V(mass=1), _V(length=1), _V(length=2), _V(time=1), _V(temperature=1)
ENERGY, POWER, PER_SHARE = _V(mass=1, length=2, time=-2), _V(mass=1, length=2, time=-3), _V(money=1, share=-1)
_SI = {"": 0, "k": 3, "m": 6, "g": 9, "t": 12, "p": 15}
_SI_WORDS = {"": 0, "kilo": 3, "mega": 6, "giga": 9, "tera": 12}
# Units with their vector, their size in the base and what is added to it.
UNITS: dict[str, tuple[Vector, Decimal, Decimal]] = {}
for _v, _sizes in (
    (MONEY, {"usd": "1", "dollar": "1", "dollars": "1", "dolares": "1", "dólares": "1", "cent": "0.01", "cents": "0.01"}),
    (SHARE, {"share": "1", "shares": "1"}),
    (LENGTH, {"metre": "1", "metres": "1", "meter": "1", "meters": "1", "km": "1000", "kilometre": "1000", "kilometres": "1000", "kilometer": "1000", "kilometers": "1000", "cm": "0.01", "ft": "0.3048", "foot": "0.3048", "feet": "0.3048", "yd": "0.9144", "yard": "0.9144", "yards": "0.9144", "inch": "0.0254", "inches": "0.0254"}),
    (AREA, {"ha": "10000", "hectare": "10000", "hectares": "10000", "acre": "4046.8564224", "acres": "4046.8564224"}),
    (MASS, {"g": "0.001", "kg": "1", "kilogram": "1", "kilograms": "1", "t": "1000", "tonne": "1000", "tonnes": "1000", "kt": "1000000", "kilotonnes": "1000000", "lb": "0.45359237", "lbs": "0.45359237", "pound": "0.45359237", "pounds": "0.45359237", "shortton": "907.18474", "oz": "0.028349523125"}),
    (TIME, {"second": "1", "seconds": "1", "minute": "60", "minutes": "60", "hour": "3600", "hours": "3600", "hr": "3600", "hrs": "3600", "h": "3600", "day": "86400", "days": "86400"}),
    (NONE, {"pct": "0.01", "permille": "0.001", "bps": "0.0001", "bp": "0.0001", "fraction": "1", "ratio": "1"}),
    (ENERGY, {f"{p}wh": str(Decimal(3600).scaleb(e)) for p, e in _SI.items()} | {f"{p}j": str(Decimal(1).scaleb(e)) for p, e in _SI.items() if p} | {f"{p}joule{x}": str(Decimal(1).scaleb(e)) for p, e in _SI_WORDS.items() for x in ("", "s")} | {f"{p}watthour{x}": str(Decimal(3600).scaleb(e)) for p, e in _SI_WORDS.items() for x in ("", "s")}),
    (POWER, {f"{p}w": str(Decimal(1).scaleb(e)) for p, e in _SI.items() if p} | {f"{p}watt{x}": str(Decimal(1).scaleb(e)) for p, e in _SI_WORDS.items() for x in ("", "s")}),
):
    UNITS |= {k: (_v, Decimal(x), Decimal(0)) for k, x in _sizes.items()}
UNITS |= {"kelvin": (HEAT, Decimal(1), Decimal(0)), "celsius": (HEAT, Decimal(1), Decimal("273.15")), "fahrenheit": (HEAT, Decimal(5) / 9, Decimal("459.67") * 5 / 9)}
#: Words of these dimensions are too common to be a unit by themselves in running text; they are one after "per" or another unit.
BY_THE_WAY = (TIME, SHARE, LENGTH)
# Spellings that are one unit word, or an operator.
SPELLINGS = (
    (r"us\s?\$|u\.s\. dollars?|us dollars?|\$", " usd "),
    (r"¢", " cent "),
    (r"per\s?cent\b|percent\b|percentage\b|prozent\b|%|\bpct\b\.?", " pct "),
    (r"per\s?mille\b|‰", " permille "),
    (r"basis\s?points?\b", " bps "),
    (r"share of 1\b", " fraction "),
    (r"tonnes co2e\b|t co2e\b|tco2e\b|metric tons?\b|metric tonnes\b", " tonne "),
    (r"short tons?\b", " shortton "),
    (r"\bsq\.?\s?(?=ft\b|m\b|km\b|yd\b|feet\b|met)", " square "),
    (r"square m\b\.?", " square metre "),
    (r"\bkm(?=[²³]|[23]\b|\^\d)", " km "),
    (r"\bm(?=[²³]|[23]\b|\^\d)", " metre "),
    (r"(?<=[a-z])\s?²|(?<=ft)2\b|(?<=metre )2\b|(?<=km )2\b", " ^2 "),
    (r"(?<=[a-z])\s?³|(?<=ft)3\b|(?<=metre )3\b|(?<=km )3\b", " ^3 "),
    (r"mil millones\b", " mrd "),
    (r"°\s?c\b|\bdegrees? c(?:elsius)?\b", " celsius "),
    (r"°\s?f\b|\bdegrees? f(?:ahrenheit)?\b", " fahrenheit "),
    (r"/", " per "),
    (r"[·×*]", " times "),
)
_SPELL = [(re.compile(p), r) for p, r in SPELLINGS]
#: Words that may stand beside an amount without changing it.
FILLERS = {"about", "approximately", "approx", "around", "roughly", "circa", "ca", "some", "nearly", "almost", "of", "de", "in", "us", "the", "a", "an", "diluted", "basic"}
_SCALE = {w: f for f, ws in SCALES.items() for w in ws}
#: The common unit of a quantity where the table names none, and the unit of a figure that has none, if it is another.
BASES = {"money": "US dollar", "per_share": "US cent per share", "ratio": "basis point", "energy": "kilowatt-hour", "area": "square metre", "mass": "kilogram", "count": "single unit"}
UNSAID = {"ratio": "per cent", "per_share": "US dollar per share"}
_NUMBER = re.compile(r"\d{1,3}(?:[ '’]\d{3})+(?:[.,]\d+)?(?![\d])|\d[\d.,]*\d(?:e[+-]?\d+)?|\d(?:e[+-]?\d+)?|[.]\d+")
_WORD = re.compile(r"[^\W\d_]+\d*|\^-?\d+")
_LONG = 2**63 - 1


def _spell(s: str) -> str:
    for p, r in _SPELL:
        s = p.sub(r, s)
    return s


def _raised(v: Vector, n: int) -> Vector:
    return tuple(n * x for x in v)


def _times(v: Vector, w: Vector) -> Vector:
    return tuple(x + y for x, y in zip(v, w, strict=True))


@lru_cache(maxsize=50_000)
def unit_of(phrase: str, quantity: str, strict: bool) -> tuple[Vector | None, Decimal | None, Decimal] | None:
    """(vector, factor, offset) that a phrase states; None if strict and a word is unknown, (None, None, 0) if it states none.

    A unit named twice over ("$ ... USD") is one; units of two dimensions side by side
    are a product only if they are a power and a time or "times" stands between them.
    """
    vector, factor, offset, scaled = None, Decimal(1), Decimal(0), False
    sign, power, product, last = 1, 1, False, None
    for w in _WORD.findall(_spell(phrase)):
        unit, scale = UNITS.get(w), _SCALE.get(w)
        if unit and scale and quantity != "mass":
            unit = None
        if w == "per":
            sign, last = -1, None
        elif w == "times":
            product = True
        elif w in ("square", "cubic"):
            power = 2 if w == "square" else 3
        elif w[0] == "^":
            if last:
                more = sign * (int(w[1:]) - 1)
                vector, factor, offset = _times(vector, _raised(last[0], more)), factor * last[1] ** more, Decimal(0)
        elif unit:
            if not strict and vector is None and sign == 1 and unit[0] in BY_THE_WAY and power == 1:
                continue
            n = sign * power
            again = last is not None and last[0] == unit[0] and not product
            joined = vector is None or sign == -1 or product or power > 1 or (last is not None and last[0] == POWER and unit[0] == TIME)
            if not again and not joined:
                return None if strict else (vector, factor, offset)
            offset = unit[2] if vector is None and n == 1 else Decimal(0)
            factor *= unit[1] ** n
            if not again:
                vector = _times(vector or NONE, _raised(unit[0], n))
            last, power, product = unit, 1, False
        elif scale:
            if sign == -1:
                factor /= scale
                if w in SCALES[Decimal(1)]:
                    vector = _times(vector or NONE, _raised(COUNT, -1))
            else:
                factor *= scale
                scaled = True
        elif w not in FILLERS:
            if strict:
                return None
            sign = 1
    if vector == MONEY and quantity == "per_share":
        vector = PER_SHARE  # a plain amount of a metric per share is one per share
    if vector is None and not scaled:
        return (None, None, Decimal(0))
    return (vector, factor, offset)


@lru_cache(maxsize=1000)
def base_unit(name: str, quantity: str) -> tuple[Vector, Decimal, Decimal] | None:
    """The common unit by the same grammar; one that names no dimension counts things."""
    read = unit_of(name.lower(), quantity, True)
    if read is None or read[1] is None:
        return None
    return (COUNT if read[0] is None else read[0], read[1], read[2])


def number(text: str, comma: bool) -> Decimal | None:
    """A figure in any notation; ``comma``: a lone comma or dot groups as in German."""
    s = re.sub(r"[ '’]", "", text)
    mantissa, _, power = s.partition("e")
    dots, commas = mantissa.count("."), mantissa.count(",")
    if dots and commas:
        dec = "," if mantissa.rfind(",") > mantissa.rfind(".") else "."
    elif commas:
        grouped = re.fullmatch(r"\d{1,3}(,\d{3})+", mantissa)
        dec = "," if commas == 1 and (comma or not grouped) else "."
    elif dots > 1 or (dots and comma and re.fullmatch(r"\d{1,3}\.\d{3}", mantissa)):
        dec = ","
    else:
        dec = "."
    mantissa = mantissa.replace("." if dec == "," else ",", "").replace(",", ".")
    try:
        return Decimal(mantissa + ("e" + power if power else ""))
    except InvalidOperation:
        return None


@lru_cache(maxsize=50_000)
def read_amount(text: str, quantity: str) -> tuple[Decimal, Vector | None, Decimal | None, Decimal] | None:
    """(signed figure, vector, factor, offset) of a property's own text, or None if it is no amount."""
    s = re.sub(r"[    ]", " ", text).replace("−", "-").replace("–", "-").strip().lower()
    m = _NUMBER.search(s)
    if not m:
        return None
    before, after = s[: m.start()], s[m.end() :]
    negative = "-" in before or ("(" in before and ")" in after) or bool(re.search(r"\b(minus|negative|loss of)\b", before))
    clean = lambda p: re.sub(r"\b(minus|negative|loss of)\b|[()~+.-]", " ", p)
    phrase = re.sub(r"\s+", " ", f"{clean(before)} {clean(after)}".strip())
    if re.search(r"(?<![a-z])\d", re.sub(r"co2e|(?:[mf]t?|km)[23]|\^-?\d|share of 1\b", "", phrase)):
        return None  # a second figure
    unit = unit_of(phrase, quantity, True)
    if unit is None:
        return None
    spelled = set(_WORD.findall(_spell(phrase)))
    comma = bool(spelled & COMMA_WORDS) or bool(re.match(r"\s+[%‰]", after))
    n = number(m.group(), comma)
    if n is None:
        return None
    return (-n if negative else n), *unit


_KEY_WORDS = re.compile(r"[a-z]+")


def base_value(quantity: str | None, key: str, text: str | None, said: list[str], hint: str | None, base: str | None = None) -> int | None:
    """The amount of one property in the base unit, rounded half away from zero.

    ``said``: texts of the key's suffix and of the record's other properties, in order; ``hint``: a scale word of the
    cited chunk; ``base``: the common unit, the usual one of the quantity without it.
    """
    if text is None:
        return None
    if key.startswith("change"):
        quantity, base = "ratio", None
    goal = base_unit(base or BASES.get(quantity or "", ""), quantity or "")
    read = read_amount(text, quantity or "") if goal else None
    if read is None:
        return None
    n, vector, factor, offset = read
    if factor is None:
        for phrase in said:
            v, f, o = unit_of(phrase.lower(), quantity, False) or (None, None, Decimal(0))
            if f is not None and (v is None or v == goal[0]):
                # currency and scale may stand in two properties
                vector, factor, offset = v if v is not None else vector, f * (factor if factor is not None else 1), o
                if v is None and quantity == "money":
                    continue
                break
    if factor is None and quantity == "money" and hint:
        factor = _SCALE.get(hint.lower())
    if vector is None:
        # a figure, or a scale, without a unit
        unsaid = base_unit(UNSAID[quantity], quantity) if quantity in UNSAID else goal
        vector, factor, offset = goal[0], (factor if factor is not None else 1) * unsaid[1], unsaid[2]
    if vector != goal[0]:
        return None
    try:
        value = int(((n * factor + offset - goal[2]) / goal[1]).to_integral_value(rounding=ROUND_HALF_UP))
    except (InvalidOperation, OverflowError):
        return None
    return value if -_LONG <= value <= _LONG else None


@F.pandas_udf(T.LongType())
def _base_values(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for cols in batches:
        yield pd.Series(
            [base_value(q, k, t, [*s], h, b) for q, k, t, s, h, b in zip(*cols, strict=True)],
            dtype="Int64",
        )


#: A scale that a filing states for its figures: "dollars in thousands", "in millions of US dollars".
_HINT = r"(?i)\bin\s+(hundreds|thousands|millions|billions)\b"


def amounts(entities: DataFrame, relationships: DataFrame, chunks: DataFrame, common_units: DataFrame) -> DataFrame:
    """Every amount of METRIC entities and REPORTS relationships in the base unit of its metric."""
    pick = lambda df, kind, wanted, table, rid, metric, cites: df.where(F.col(kind) == wanted).select(
        F.lit(table).alias("rec_table"), F.col(rid).alias("rec_id"), fold(F.col(metric)).alias("metric"), F.col("properties").alias("props"), cites.alias("cites")
    )
    records = pick(entities, "entity_type", "METRIC", "entities", "entity_id", "name", F.col("chunk_ids")).unionByName(
        pick(relationships, "relation", "REPORTS", "relationships", "rel_id", "source", F.array("chunk_id"))
    )
    units = common_units.select(fold(F.col("metric")).alias("metric"), "quantity", F.col("base_unit").alias("base")).groupBy("metric").agg(F.min(F.struct("quantity", "base")).alias("u")).select("metric", "u.*")
    units = F.broadcast(units) if _small(common_units) else units
    figure = r"^(value|prior_value|change)"
    others = F.map_filter("props", lambda k, v: ~k.rlike(figure) & v.isNotNull())
    first = F.array(F.lit("unit"), F.lit("scale"), F.lit("currency"), F.lit("note"))
    ordered = F.concat(
        F.filter(F.transform(first, lambda k: F.try_element_at("others", k)), lambda v: v.isNotNull()),
        F.map_values(F.map_filter("others", lambda k, v: ~F.array_contains(first, k))),
    )
    props = (
        records.join(units, "metric")
        .withColumn("others", others)
        .select("rec_table", "rec_id", "quantity", "base", "cites", ordered.alias("said"), F.explode("props").alias("prop_key", "txt"))
        .where(F.col("prop_key").rlike(figure) & (F.trim("txt") != ""))
        .withColumn("said", F.concat(F.array(F.regexp_replace(F.regexp_replace("prop_key", figure, ""), "_", " ")), F.col("said")))
    )
    # only money that says nothing of its scale needs the cited chunk; the hint is cut out
    # of the text before the shuffle, and there is one a chunk_id
    told = r"(?i)(?<![a-z])(usd|us|dollars?|cents?|" + "|".join(sorted(_SCALE)) + r")(?![a-z])|[$¢]"
    bare = (
        (F.col("quantity") == "money")
        & ~F.col("prop_key").startswith("change")
        & F.col("txt").rlike(rf"(?i)^\W*(?:{'|'.join(sorted(FILLERS))})?[^a-z$¢]*$")
        & ~F.exists("said", lambda s: s.rlike(told))
    )
    props = props.withColumn("need", F.when(bare, F.filter("cites", lambda c: c.isNotNull())))
    plain = props.where(F.col("need").isNull() | (F.size("need") == 0)).withColumn("hint", F.lit(None).cast("string"))
    hints = (
        chunks.select("chunk_id", F.regexp_extract("text", _HINT, 1).alias("h"))
        .where((F.col("h") != "") & F.col("chunk_id").isNotNull())
        .groupBy("chunk_id")
        .agg(F.min("h").alias("h"))
    )
    needed = props.where(F.size("need") > 0)
    cited = needed.select("rec_table", "rec_id", "prop_key", "txt", "quantity", "base", "cites", "said", "need", F.posexplode("need").alias("at", "chunk_id"))
    hinted = (
        cited.join(hints, "chunk_id", "left")
        .groupBy("rec_table", "rec_id", "prop_key", "txt", "quantity", "base", "said")
        .agg(F.min_by("h", F.when(F.col("h").isNotNull(), F.col("at"))).alias("hint"))
    )
    cols = ["rec_table", "rec_id", "prop_key", "txt", "quantity", "base", "said", "hint"]
    return (
        plain.select(*cols)
        .unionByName(hinted.select(*cols))
        .select("rec_table", "rec_id", "prop_key", _base_values("quantity", "prop_key", "txt", "said", "hint", "base").alias("base_value"))
        .where(F.col("base_value").isNotNull())
    )


def _small(df: DataFrame, rows: int = 20_000) -> bool:
    """Whether a table is small enough to broadcast; reads at most ``rows`` + 1 of its rows."""
    return len(df.select(F.lit(1)).limit(rows + 1).take(rows + 1)) <= rows
