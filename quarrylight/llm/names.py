"""Variant spellings of the names of persons and organisations.

A spelling is read into an anchor (family name, or the firm's own word), which is
rare, and qualifiers (given name, or trade), which are common.  Anchors of one
ticker and type meet in a prefix-filtered set-similarity join on their q-grams:
a slip changes at most ``SLIP`` q-grams, and the similarity that is asked for
lets one slip for ``LETTERS`` letters pass, so two such anchors share one of the
``SLIP`` * (length / ``LETTERS``) + 1 rarest q-grams of each.  A firm's own words
meet in any order.  Pairs are verified by a soft similarity of anchor and
qualifier, weighted by rarity, of at least ``ALIKE``: between one slip in four
and one in five letters it is the rarity that decides.  A clash of qualifiers
(relatives, sister firms) is a veto.  Verified links and aliases of one row are
closed to classes.  A spelling without its qualifier (initials, family name
alone) joins a class only if no other class would take it; those that no class
takes form classes among themselves, by slips and by the aliases of their rows.

Defined results: rows of other types and rows with a null ticker, null name
without aliases, or no letter are in no class; null and empty aliases do not
count; repeated rows are members of their own; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.text import fold
from quarrylight.session import cut

Q = 3
#: The most q-grams that one slip (a swap of neighbours) changes.
SLIP = Q + 1
#: The similarity from which two spellings are one, and what a qualifier weighs at least and at most, as a share of its anchor's weight.
ALIKE, QUAL_LEAST, QUAL_MOST = 0.85, 1 / 3, 2 / 3
#: One slip for so many letters of the shorter anchor is the most that ``ALIKE`` lets pass: own + QUAL_MOST >= ALIKE * (1 + QUAL_MOST) is own >= 3 / 4.
LETTERS = 4
#: q-grams are counted in so many buckets, which bounds the table of their frequencies.
GRAM_BUCKETS = 1 << 16
#: A token is a qualifier if this share of all spellings has it (at most 1 / share x tokens a spelling of them).
COMMON_SHARE = 0.002
PERSON, FIRM = "PERSON", "COMPETITOR"

#: Short forms that the aliases of rows give for names of so many families, or more, are learned; the most that are kept.
LEARN_FROM, MOST_LEARNED = 2, 100_000
# Short forms of given names, the default of the parameter ``nicknames``.
NICKNAMES = {
    "alexandra": "sasha alex lexi sandra", "anthony": "tony ant", "charles": "chuck charlie", "deborah": "deb debbie debby", "edward": "ned eddie ed ted",
    "elizabeth": "liz beth betty eliza lizzie", "francis": "frank fran", "gregory": "greg", "hendrik": "henk rik", "ingrid": "inga", "james": "jim jimmy jamie",
    "johannes": "hans jan", "katherine": "kate kathy katie kat", "leonard": "leo len lenny", "margaret": "peggy maggie meg marge", "michael": "mike mick mickey",
    "nathaniel": "nate nathan nat", "olivia": "liv livvy", "patricia": "trish pat patty tricia", "rebecca": "becky becca", "richard": "dick rick rich ricky",
    "robert": "bob rob bobby robbie", "susan": "sue susie suzy", "theodore": "ted theo teddy", "ulrich": "uli ully", "victoria": "vicky vic tori", "vincent": "vinny vince vin",
    "william": "bill will billy willy", "yolanda": "yoli yola", "zachary": "zach zack", "andrew": "andy drew", "benjamin": "ben benny", "christopher": "chris kit",
    "daniel": "dan danny", "david": "dave davy", "donald": "don donny", "jennifer": "jen jenny", "john": "jack johnny", "joseph": "joe joey", "kenneth": "ken kenny",
    "matthew": "matt", "nicholas": "nick nicky", "peter": "pete", "philip": "phil", "samuel": "sam sammy", "stephen": "steve", "thomas": "tom tommy", "timothy": "tim",
}
# Titles and suffixes of persons.
TITLES = frozenset("mr mrs ms miss dr prof professor sir dame lord lady hon rev herr frau mme mlle sr sra jr snr ii iii iv phd md mba cfa esq chair chairman chairwoman ceo cfo coo cto president director vp".split())
# Legal forms and words that firms add.
LEGAL = frozenset("inc incorporated corp corporation co company ltd limited llc llp lp plc gmbh ag kg sa sas srl spa bv nv oy ab as group holding holdings the".split())
# Words of trades with their short forms.
TRADES = {
    "industries": "ind inds industry", "systems": "sys system", "technologies": "tech technology techs", "services": "svcs svc service serv", "manufacturing": "mfg manuf",
    "laboratories": "labs lab laboratory", "international": "intl int'l", "logistics": "logist log", "foods": "food", "partners": "partner ptnrs", "solutions": "soln solns solution",
    "associates": "assoc assocs", "brothers": "bros", "enterprises": "ent entpr enterprise", "engineering": "eng engr",
}
_TRADE = {s: t for t, ss in TRADES.items() for s in [t, *ss.split()]}
_SLIPS = str.maketrans("013457", "oleast")


def _ascii(s: str) -> str:
    s = s.replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _tokens(s: str) -> list[str]:
    out = []
    for w in re.findall(r"[^\W_]+", s.replace("&", " and ").replace("'", "").replace("’", "")):
        letters = sum(c.isalpha() for c in w)
        out.append(w.translate(_SLIPS) if letters and letters < len(w) else w)
    return out


def slips(a: str, b: str, most: int = 1) -> int:
    """Edit distance with swaps of neighbours, or ``most`` + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if most == 1:
        i = 0
        n, m = len(a), len(b)
        while i < n and i < m and a[i] == b[i]:
            i += 1
        if n == m:
            if a[i + 1 :] == b[i + 1 :]:
                return 1
            return 1 if a[i + 2 :] == b[i + 2 :] and a[i] == b[i + 1] and a[i + 1] == b[i] else 2
        return 1 if (a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]) else 2
    over = most + 1
    before, last = [], [j if j <= most else over for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [over] * (len(b) + 1)
        row[0] = min(i, over)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = min(d, over)
        before, last = last, row
        if min(row) >= over and min(before) >= over:
            break
    return min(last[-1], over)


class Reader:
    """Reads spellings into (anchor, qualifier, initials, short form); ``turned`` gives the anchor of a firm in sorted order of its words."""

    def __init__(self, common: dict[str, frozenset[str]], nicknames: dict[str, str] | None = None):
        nicknames = NICKNAMES if nicknames is None else nicknames
        self.names = frozenset(nicknames)
        # a short form of two names stands for either
        self.short: dict[str, set[str]] = {}
        for name, forms in nicknames.items():
            for x in forms.split():
                self.short.setdefault(x, set()).add(name)
        givens = {*self.names, *self.short} | {w for w in common.get(PERSON, ()) if len(w) >= 3 and w not in TITLES}
        self.givens = frozenset(givens)
        self.trades = frozenset({*_TRADE, "and"} | {w for w in common.get(FIRM, ()) if len(w) >= 3 and w not in LEGAL})
        self._given = lru_cache(100_000)(self._given)
        self._trade = lru_cache(100_000)(self._trade)

    def _near(self, w: str, words: frozenset[str]) -> str | None:
        """The one word a slip away, if it is long enough for a slip to be seen."""
        hits = {x for x in words if len(x) >= 4 and slips(w, x) == 1} if len(w) >= 4 else set()
        full = {x for x in hits if x in self.names or x in TRADES} or hits
        return min(full) if full else None

    def _given(self, w: str) -> str | None:
        """The given name a token stands for; several short forms are kept apart by '/'."""
        if w in self.names:
            return w
        if w in self.short:
            return "/".join(sorted(self.short[w]))
        near = self._near(w, self.names)
        if near:
            return near
        if w in self.givens:
            return w
        near = self._near(w, self.givens)
        return (self._given(near) if near in self.short else near) if near else None

    def _trade(self, w: str) -> str | None:
        if w in _TRADE:
            return _TRADE[w]
        if w == "and":
            return w
        near = self._near(w, frozenset(_TRADE))
        if near:
            return _TRADE[near]
        if w in self.trades:
            return w
        near = self._near(w, self.trades)
        if near:
            return near
        return next((t for t in TRADES if len(w) >= 3 and t.startswith(w)), None)

    def person(self, s: str) -> tuple[str, str, str, str]:
        parts = [[w for w in _tokens(p) if w not in TITLES] for p in s.split(",")]
        parts = [p for p in parts if p]
        if not parts:
            return "", "", "", ""
        turned = len(parts) > 1
        words = [w for p in ((parts[1:] + parts[:1]) if turned else parts) for w in p]
        initials = "".join(w for w in words if len(w) <= 2)
        full = [w for w in words if len(w) > 2]
        if not full:
            return "", "", initials, ""
        if len(full) == 1:
            w = full[0]
            if not initials:
                for g in sorted(self.givens, key=len, reverse=True):
                    if len(g) >= 3 and len(w) >= len(g) + 4:
                        rest = w[len(g) :] if w.startswith(g) else w[: -len(g)] if w.endswith(g) and len(g) >= 5 else ""
                        if rest:
                            return rest, self._given(g), "", ""
            return w, "", initials[:1], ""
        given = [self._given(w) for w in full]
        if all(given):
            # a family name that is also a given name stands last
            return full[-1], given[0], "", ""
        if any(given):
            return "".join(w for w, g in zip(full, given, strict=True) if not g), next(g for g in given if g), "", ""
        return "".join(full[1:]), full[0], "", ""

    def turned(self, kind: str, s: str) -> str:
        plain = _ascii(s)
        if kind != FIRM or not re.search(r"[a-z]", plain):
            return ""
        own = self._own(plain)[0]
        return "".join(sorted(own)) if len(own) > 1 else ""

    def _own(self, s: str) -> tuple[list[str], list[str | None]]:
        """The firm's own words, and what trade each word is."""
        words = [w for w in _tokens(s) if w not in LEGAL]
        if len(words) > 1:
            words = [w for w in words if len(w) > 1] or words
            if self._near(words[-1], LEGAL) and not self._trade(words[-1]):
                words = words[:-1]
        if len(words) == 1 and len(words[0]) > 8:
            w, tail = words[0], []
            more = True
            while more:
                more = False
                for t in sorted(self.trades, key=len, reverse=True):
                    if len(t) >= 3 and w.endswith(t) and len(w) >= len(t) + 4 and (t in TRADES or t == "and" or len(t) >= 6):
                        w, more = w[: -len(t)], True
                        tail.insert(0, t)
                        break
            if any(t != "and" for t in tail):
                words = [w, *tail]
        trade = [self._trade(w) for w in words]
        return [w for w, t in zip(words, trade, strict=True) if not t], trade

    def firm(self, s: str) -> tuple[str, str, str, str]:
        own, trade = self._own(s)
        kinds = sorted({t for t in trade if t and t != "and"})
        core = "".join(own)
        if len(core) <= 2 or (len(own) == 1 and len(core) == 3 and not kinds):
            return "", "", "", core
        short = core[0] + "".join(t[0] for t in dict.fromkeys(t for t in trade if t and t != "and"))
        return core, " ".join(kinds), "", short if kinds else ""

    def read(self, kind: str, s: str) -> tuple[str, str, str, str]:
        plain = _ascii(s)
        if not re.search(r"[a-z]", plain):  # other scripts are compared as they stand
            return ("".join(_tokens(s)), " ", "", "")
        return self.person(plain) if kind == PERSON else self.firm(plain)


_READ = T.StructType([T.StructField(c, T.StringType()) for c in ("anchor", "qual", "initial", "short", "turned")])


def _reader(common: dict[str, frozenset[str]], nicknames: dict[str, str]):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        reader = Reader(common, nicknames)
        for kinds, spellings in batches:
            yield pd.DataFrame([(*reader.read(k, s), reader.turned(k, s)) for k, s in zip(kinds, spellings, strict=True)], columns=_READ.names)

    return run


def similar(a: str, b: str, qa: str, qb: str, wa: float, wb: float) -> bool:
    """Soft token similarity of anchor and qualifier against ``ALIKE``, weighted by rarity; a clash of qualifiers is a veto.

    ``wa``, ``wb``: weights of the qualifiers as shares of the weights of their anchors.
    """
    if qa != qb:
        if not set(qa.split("/")) & set(qb.split("/")) and not (slips(qa, qb) <= 1 and min(len(qa), len(qb)) >= 4 and " " not in qa + qb and not (qa in NICKNAMES and qb in NICKNAMES)):
            return False
    shorter = min(len(a), len(b))
    most = shorter // LETTERS
    off = slips(a, b, max(1, most))
    if off > most:
        return False
    weight = min(max((wa + wb) / 2, QUAL_LEAST), QUAL_MOST)
    own = 1 - off / max(1, shorter)
    return own + weight >= ALIKE * (1 + weight) - 1e-9


@F.pandas_udf(T.BooleanType())
def _similar(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for cols in batches:
        yield pd.Series([similar(*r) for r in zip(*cols, strict=True)], dtype=bool)


def _mentions(entities: DataFrame) -> DataFrame:
    """(entity_id, ticker, kind, spelling) of names and aliases, folded."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        entities.where(F.col("entity_type").isin(PERSON, FIRM) & F.col("ticker").isNotNull())
        .select("entity_id", "ticker", F.col("entity_type").alias("kind"), F.explode(F.array_distinct(F.transform(every, fold))).alias("spelling"))
        .where(F.col("spelling").isNotNull() & F.col("spelling").rlike(r"\p{L}"))
    )


def _common(spellings: DataFrame) -> dict[str, frozenset[str]]:
    """The frequent tokens of each kind: at most tokens-a-spelling / COMMON_SHARE, whatever the corpus."""
    total = {r["kind"]: r["count"] for r in spellings.groupBy("kind").count().collect()}
    if not total:
        return {}
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(max(3.0, n * COMMON_SHARE))) for k, n in total.items()])
    words = F.array_distinct(F.regexp_extract_all("spelling", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    seen = spellings.select("kind", "ticker", F.explode(words).alias("w")).groupBy("kind", "w", "ticker").count().groupBy("kind", "w").agg(F.sum("count").alias("n"), F.count("*").alias("tickers"))
    out: dict[str, set[str]] = {}
    for r in seen.where((F.col("n") >= least) & (F.col("tickers") >= 3)).collect():
        out.setdefault(r["kind"], set()).add(_ascii(r["w"]))
    return {k: frozenset(v) for k, v in out.items()}


def _gram_pairs(anchors: DataFrame) -> DataFrame:
    """Pairs of anchors of one ticker and kind that share one of their rarest q-grams."""
    padded = F.concat(F.lit("#" * (Q - 1)), F.col("anchor"), F.lit("$" * (Q - 1)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (Q - 1)), lambda i: F.pmod(F.hash(F.substring(padded, i, F.lit(Q))), F.lit(GRAM_BUCKETS))))
    each = anchors.select("ticker", "kind", "anchor", F.explode(grams).alias("gram"))
    often = F.broadcast(each.groupBy("gram").agg(F.count("*").alias("n")))  # GRAM_BUCKETS rows at most
    most = F.greatest(F.lit(1), F.floor(F.length("anchor") / LETTERS)).cast("int")
    prefix = (
        each.join(often, "gram")
        .groupBy("ticker", "kind", "anchor")
        .agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("all"))
        .select("ticker", "kind", "anchor", F.transform(F.slice("all", F.lit(1), most * SLIP + 1), lambda x: x["gram"]).alias("prefix"))
    )
    part = prefix.select("ticker", "kind", "anchor", "prefix", F.length("anchor").alias("len"), F.explode("prefix").alias("gram"))
    a, b = part.alias("a"), part.alias("b")
    slips_most = F.greatest(F.lit(1), F.floor(F.least("a.len", "b.len") / LETTERS))
    on = (
        (F.col("a.ticker") == F.col("b.ticker"))
        & (F.col("a.kind") == F.col("b.kind"))
        & (F.col("a.gram") == F.col("b.gram"))
        & (F.col("a.anchor") < F.col("b.anchor"))
        & (F.abs(F.col("a.len") - F.col("b.len")) <= slips_most)
        # a swap counts twice; beyond the bound it is not counted on
        & (F.call_function("levenshtein", F.col("a.anchor"), F.col("b.anchor"), (2 * slips_most).cast("int")) >= 0)
        # a pair comes out of its first common q-gram only
        & (F.element_at(F.array_intersect("a.prefix", "b.prefix"), 1) == F.col("a.gram"))
    )
    return a.join(b, on).select(F.col("a.ticker").alias("ticker"), F.col("a.kind").alias("kind"), F.col("a.anchor").alias("anchor"), F.col("b.anchor").alias("other"))


def _key(*cols: str):
    return F.concat_ws("\x1f", *cols)


def _close(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label): the least node of each component, for the nodes that have edges."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "m").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        after = cut(step.join(jump, step["new"] == jump["at"], "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        moved = after.where(F.col("label") != F.col("new")).limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not moved:
            break
    else:
        raise RuntimeError(f"components not closed in {rounds} rounds")
    return labels


def _learned(mentions: DataFrame, common: dict[str, frozenset[str]], nicknames: dict[str, str]) -> dict[str, str]:
    """The short forms with those that aliases tell: two given names of one row and family, in ``LEARN_FROM`` families or more.

    The more frequent of the two counts as the name.  Slips are none, and neither are names that both are in the list.
    """
    read = F.pandas_udf(_reader(common, nicknames), _READ)
    several = mentions.where(F.col("kind") == PERSON).groupBy("entity_id", "ticker").agg(F.collect_set("spelling").alias("all")).where(F.size("all") > 1)
    rows = several.select("entity_id", "ticker", F.explode("all").alias("spelling")).select("entity_id", "ticker", read(F.lit(PERSON), "spelling").alias("r"))
    given = rows.select("entity_id", "ticker", "r.anchor", "r.qual").where((F.length("qual") > 2) & ~F.contains("qual", F.lit("/"))).distinct()
    both = given.join(given.withColumnRenamed("qual", "other"), ["entity_id", "ticker", "anchor"]).where(F.col("qual") < F.col("other"))
    told = both.select("qual", "other", "ticker", "anchor").distinct().groupBy("qual", "other").count().where(F.col("count") >= LEARN_FROM)
    often = given.groupBy("qual").agg(F.count("*").alias("n"))
    pairs = told.join(often.withColumnRenamed("n", "na"), "qual").join(often.select(F.col("qual").alias("other"), F.col("n").alias("nb")), "other").limit(MOST_LEARNED + 1).collect()
    if len(pairs) > MOST_LEARNED:
        raise ValueError(f"more than {MOST_LEARNED} learned short forms")
    out = dict(nicknames)
    for r in sorted(pairs, key=lambda r: (r["qual"], r["other"])):
        name, short = (r["qual"], r["other"]) if r["na"] >= r["nb"] else (r["other"], r["qual"])
        if slips(name, short) > 1 and not (name in nicknames and short in nicknames):
            out[name] = f"{out.get(name, '')} {short}".strip()
    return out


def members(entities: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(entity_id, ticker, kind, cluster, links): the class of each row of persons and firms, and how many spellings its own is linked to.

    ``nicknames``: short forms of given names, the fixed ones if none are given; those that aliases tell are added.
    """
    mentions = _mentions(entities)
    spellings = mentions.select("ticker", "kind", "spelling").distinct()
    common = _common(spellings)
    read = F.pandas_udf(_reader(common, _learned(mentions, common, NICKNAMES if nicknames is None else nicknames)), _READ)
    distinct = mentions.select("kind", "spelling").distinct().withColumn("r", read("kind", "spelling"))
    keyed = cut(
        mentions.join(distinct, ["kind", "spelling"])
        .select("entity_id", "ticker", "kind", "r.*")
        .withColumn("full", (F.col("anchor") != "") & (F.col("qual") != ""))
    )
    strong = keyed.where("full").withColumn("node", _key("ticker", "kind", "anchor", "qual"))
    nodes = strong.groupBy("ticker", "kind", "anchor", "qual").agg(F.count("*").alias("n"), F.max("short").alias("short"))
    anchors = keyed.where(F.col("anchor") != "")
    # the words of a firm in any order: anchors meet by either form
    forms = cut(anchors.select("ticker", "kind", "anchor", F.explode(F.array("anchor", "turned")).alias("form")).where(F.col("form") != "").distinct())
    near = _gram_pairs(forms.select("ticker", "kind", F.col("form").alias("anchor")).distinct()).select("ticker", "kind", F.col("anchor").alias("form"), F.col("other").alias("form2"))
    near = near.unionByName(near.select("ticker", "kind", F.col("form2").alias("form"), F.col("form").alias("form2")))
    turned = forms.where(F.col("form") != F.col("anchor")).select("ticker", "kind", "form").distinct().withColumn("form2", F.concat("form", F.lit("")))
    second = forms.select("ticker", "kind", F.col("anchor").alias("other"), F.col("form").alias("form2"))
    pairs = cut(forms.join(near.unionByName(turned), ["ticker", "kind", "form"]).join(second, ["ticker", "kind", "form2"]).where(F.col("anchor") < F.col("other")).select("ticker", "kind", "anchor", "other", "form", "form2").distinct())
    # rarity of anchors and qualifiers among the spellings of their kind
    whole_kind = F.broadcast(nodes.groupBy("kind").agg(F.sum("n").alias("total")))
    rare = lambda c: nodes.groupBy("kind", c).agg(F.sum("n").alias("m")).join(whole_kind, "kind").select("kind", c, F.log(1 + F.col("total") / F.col("m")).alias(f"w_{c}"))
    weighed = cut(nodes.join(rare("anchor"), ["kind", "anchor"]).join(rare("qual"), ["kind", "qual"]).select("ticker", "kind", "anchor", "qual", (F.col("w_qual") / F.col("w_anchor")).alias("w")))
    left = weighed.select("ticker", "kind", "anchor", F.col("qual").alias("qa"), F.col("w").alias("wa"))
    right = weighed.select("ticker", "kind", F.col("anchor").alias("other"), F.col("qual").alias("qb"), F.col("w").alias("wb"))
    met = left.join(pairs, ["ticker", "kind", "anchor"]).join(right, ["ticker", "kind", "other"])
    same = left.withColumn("other", F.concat("anchor", F.lit(""))).withColumn("form", F.concat("anchor", F.lit(""))).withColumn("form2", F.concat("anchor", F.lit(""))).join(right, ["ticker", "kind", "other"]).where(F.col("qa") < F.col("qb"))
    linked = met.unionByName(same.select(*met.columns)).where(_similar("form", "form2", "qa", "qb", "wa", "wb"))
    spelled = linked.select(_key("ticker", "kind", "anchor", "qa").alias("a"), _key("ticker", "kind", "other", "qb").alias("b"))
    # the spellings of one row mean one thing
    per_row = strong.groupBy("entity_id").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.collect_set("node").alias("all"))
    aliased = per_row.where(F.col("first") < F.col("last")).select(F.col("first").alias("a"), F.explode("all").alias("b")).where(F.col("a") < F.col("b"))
    edges = cut(spelled.unionByName(aliased).distinct())
    closed = _close(edges)
    degree = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("links"))
    named = (
        nodes.withColumn("node", _key("ticker", "kind", "anchor", "qual"))
        .join(closed, "node", "left")
        .join(degree, F.col("node") == F.col("a"), "left")
        .select("ticker", "kind", "anchor", "qual", "short", "node", F.coalesce("label", "node").alias("cluster"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
    )
    named = cut(named)
    sure = per_row.join(named.select("node", "cluster", "links"), F.col("first") == F.col("node")).select("entity_id", "cluster", "links")
    # rows that only have spellings without a qualifier
    weak = keyed.join(per_row.select("entity_id"), "entity_id", "left_anti").where((F.col("anchor") != "") | (F.col("short") != "")).withColumn("lone", F.lit("?"))
    asked = weak.select("ticker", "kind", "anchor", "initial", "short").distinct()
    around = pairs.unionByName(pairs.select("ticker", "kind", F.col("other").alias("anchor"), F.col("anchor").alias("other"), F.col("form2").alias("form"), F.col("form").alias("form2")))
    exact = asked.where(F.col("anchor") != "").withColumn("other", F.concat("anchor", F.lit(""))).withColumn("far", F.lit(0))
    close = asked.join(around, ["ticker", "kind", "anchor"]).where((F.col("form") == F.col("form2")) | ((F.length("form") >= 5) & (F.levenshtein("form", "form2", 2) >= 0))).withColumn("far", F.lit(1))
    takes = F.when(F.col("initial") == "", True).otherwise(F.exists(F.split("qual", "/"), lambda g: g.startswith(F.col("initial"))))
    whole = named.select("ticker", "kind", F.col("anchor").alias("other"), "qual", "cluster")
    by_anchor = exact.unionByName(close.select(*exact.columns)).join(whole, ["ticker", "kind", "other"]).where(takes)
    by_short = asked.where(F.col("anchor") == "").join(named.select("ticker", "kind", "short", "cluster"), ["ticker", "kind", "short"]).withColumn("far", F.lit(0))
    offer = ["ticker", "kind", "anchor", "initial", "short", "far", "cluster"]
    offers = by_anchor.select(*offer).unionByName(by_short.select(*offer))
    best = (
        offers.groupBy(*offer[:5], "far")
        .agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
        .groupBy(*offer[:5])
        .agg(F.min_by(F.struct("lo", "hi"), "far").alias("c"))
        .select(*offer[:5], F.when(F.col("c.lo") == F.col("c.hi"), F.col("c.lo")).alias("taken"), F.when(F.col("c.lo") != F.col("c.hi"), True).alias("torn"))
    )
    own = _key("ticker", "kind", "anchor", "initial", "lone", "short")
    offered = cut(weak.join(best, offer[:5], "left").withColumn("own", own).withColumn("free", F.col("taken").isNull() & F.col("torn").isNull()))
    rest = _rest(offered, around, keyed.where(~F.col("full")).withColumn("lone", F.lit("?")).withColumn("own", own).join(sure, "entity_id").select("own", F.col("cluster").alias("taken")))
    placed = (
        offered.join(rest, "own", "left")
        .groupBy("entity_id")
        .agg(F.coalesce(F.min("taken"), F.min("label"), F.min("own")).alias("cluster"))
        .withColumn("links", F.lit(0).cast("bigint"))
    )
    kinds = mentions.select("entity_id", "ticker", "kind").distinct()
    return sure.unionByName(placed).join(kinds, "entity_id").select("entity_id", "ticker", "kind", "cluster", "links")


def _only(offers: DataFrame) -> DataFrame:
    """(label, to): what all offers of a label agree on."""
    return offers.groupBy("label").agg(F.min("to").alias("to"), F.max("to").alias("hi")).where(F.col("to") == F.col("hi")).select("label", "to")


def _rest(offered: DataFrame, around: DataFrame, aliases: DataFrame) -> DataFrame:
    """(own, label): the classes of weak spellings that no class of full spellings takes.

    Those of one row are one, and so are those a slip apart with one initial if no
    full spelling is near.  Such a group then joins the one class that a near weak
    spelling, or a row with this alias, is in; a family name alone joins the one
    group with an initial.
    """
    nodes = cut(offered.select("own", "ticker", "kind", "anchor", "initial", "taken", "free").distinct())
    other = nodes.select("ticker", "kind", F.col("anchor").alias("other"), F.col("initial").alias("i2"), F.col("own").alias("own2"), F.col("taken").alias("taken2"), F.col("free").alias("free2"))
    free = nodes.where("free").where(F.col("anchor") != "")
    empty, least = F.lit(""), F.lit(QUAL_LEAST)  # without a qualifier the anchor has to be as near as beside a common one
    near = free.join(around, ["ticker", "kind", "anchor"]).join(other, ["ticker", "kind", "other"])
    near = near.where(_similar("form", "form2", empty, empty, least, least)).drop("form", "form2")
    near = cut(near.unionByName(free.withColumn("other", F.concat("anchor", F.lit(""))).join(other, ["ticker", "kind", "other"]).where(F.col("own") != F.col("own2")).select(*near.columns)))
    alike = near.where(F.col("initial") == F.col("i2"))
    row = offered.where(F.col("taken").isNull()).groupBy("entity_id").agg(F.min("own").alias("a"), F.collect_set("own").alias("all"))
    edges = alike.where("free2").select(F.col("own").alias("a"), F.col("own2").alias("b")).unionByName(row.select("a", F.explode("all").alias("b")).where(F.col("a") != F.col("b"))).distinct()
    closed = _close(edges).withColumnRenamed("node", "own")
    label = cut(nodes.where(F.col("taken").isNull()).join(closed, "own", "left").select("own", "initial", "free", F.coalesce("label", "own").alias("label")))
    open_ = label.where("free").select("own", "label")
    # nearest evidence first: a weak spelling that is taken, or a row that has this one as an alias
    said = alike.where(F.col("taken2").isNotNull()).select("own", F.col("taken2").alias("to"))
    rows = offered.where(F.col("taken").isNotNull()).select("entity_id", "taken").join(offered.where("free").select("entity_id", "own"), "entity_id")
    said = said.unionByName(rows.select("own", F.col("taken").alias("to"))).unionByName(aliases.select("own", F.col("taken").alias("to")))
    joined = cut(label.join(_only(open_.join(said, "own").select("label", "to")), "label", "left").select("own", "initial", "free", "label", "to"))
    alone = joined.where(F.col("free") & (F.col("initial") == "") & F.col("to").isNull()).select("own", "label")
    whose = joined.where("free").select(F.col("own").alias("own2"), F.coalesce("to", "label").alias("whose"))
    lone = near.where((F.col("initial") == "") & (F.col("i2") != "") & F.col("free2")).select("own", "own2").join(whose, "own2")
    single = _only(alone.join(lone, "own").select("label", F.col("whose").alias("to"))).select("label", F.col("to").alias("single"))
    return joined.join(single, "label", "left").select("own", F.coalesce("to", "single", "label").alias("label"))


def classes(entities: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """One row an entity: its class and the number of spellings its own is linked to."""
    return members(entities, nicknames).select("entity_id", "ticker", F.col("kind").alias("entity_type"), F.xxhash64("cluster").alias("class_id"), F.col("links").alias("n_links"))


def same_pairs(entities: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """All pairs of rows of one class, smaller id first; the number of pairs is what was asked for."""
    rows = cut(members(entities, nicknames).select("cluster", "entity_id"))
    a, b = rows.select("cluster", F.col("entity_id").alias("entity_id_a")), rows.select("cluster", F.col("entity_id").alias("entity_id_b"))
    return a.join(b, "cluster").where(F.col("entity_id_a") < F.col("entity_id_b")).select("entity_id_a", "entity_id_b")
