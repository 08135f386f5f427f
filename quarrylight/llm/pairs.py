"""Prompt and response pairs that nobody can use, with the kind of defect.

The checks run in order, and a pair has the first defect that holds: ``empty``,
``copied_question`` (a suffix automaton of the question measures how much of the
answer it covers), ``refusal`` (an automaton of refusing phrases and what a refusing
sentence is made of; nothing but courtesy and sources may stand beside it), then
``other_language`` (votes of frequent words; against the language of the question
count only those that one of the two has alone, with or without a leading label;
at least two, and twice as many as speak for the question's) and ``truncated`` (ends, open
delimiters, dangling items).

Defined results: a null answer is empty; with a null or blank question nothing
is copied, and its language is that of the hint, if there is one; rows with a
null id are left out; exact copies give one row; empty tables give none; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_WORDS = 50_000

# Marks and words that stand for no answer.
PLACEHOLDERS = frozenset(
    "null none nil nan na n/a n.a. undefined empty blank tbd todo tba pending missing placeholder answer a response reply "
    "no_answer no-answer unknown_answer error antwort réponse respuesta risposta lorem xxx test".split()
) | {"no answer", "not available", "no response", "keine antwort", "sin respuesta", "pas de réponse", "insert answer here", "your answer here", "answer here"}
# How a speaker says that it cannot or will not, and what it then does not do; each of the first with each of the second is a refusing phrase.
UNABLE = {
    "en": ("can't", "cannot", "can not", "could not", "couldn't", "unable to", "not able to", "won't", "will not", "not permitted to", "not allowed to", "not in a position to", "must decline to", "have to decline to", "decline to", "refuse to", "rather not", "prefer not to", "not possible to", "no way to"),
    "fr": ("ne peux pas", "ne pouvons pas", "ne puis", "ne suis pas en mesure de", "ne sommes pas en mesure de", "pas possible de", "impossible de", "refuse de", "dois refuser de", "pas autorisé à"),
    "es": ("no puedo", "no podemos", "no me es posible", "no es posible", "no soy capaz de", "me niego a", "debo negarme a", "no estoy autorizado a", "no estoy autorizada a"),
}
SPEECH = {
    "en": ("answer", "respond", "reply", "help", "assist", "provide", "share", "discuss", "comment", "say", "tell", "give", "offer", "disclose", "determine", "confirm", "guess", "speculate", "address", "advise", "find", "know"),
    "de": ("beantworten", "antworten", "antwort", "helfen", "weiterhelfen", "sagen", "geben", "nennen", "mitteilen", "äußern", "auskunft", "bestimmen", "ermitteln", "beurteilen", "finden", "weiß", "ablehnen", "angaben"),
    "fr": ("répondre", "réponse", "aider", "dire", "fournir", "donner", "indiquer", "communiquer", "préciser", "commenter", "déterminer", "trouver", "savoir", "sais"),
    "es": ("responder", "respuesta", "contestar", "ayudar", "ayudarle", "decir", "dar", "ofrecer", "facilitar", "proporcionar", "comentar", "determinar", "indicar", "encontrar", "saber", "sé"),
}
# Words that put a thing out of reach.
BEYOND = re.compile(r"\b(?:outside|beyond|außerhalb|hors|au-delà|fuera|más allá)\b")
# Refusing phrases that are not made of these.
REFUSALS = (
    "outside my", "beyond my", "against my guidelines", "against my policy", "against our policy", "no access to", "insufficient information", "not enough information",
    "muss ich ablehnen", "nicht in der lage", "keine auskunft", "hors de mon", "fuera de mi", "non posso", "non sono in grado",
)
# The one who speaks, what it can or will, and what it has or lacks.
SPEAKER = re.compile(r"\b(?:i|i'm|i've|i'd|i'll|me|my|we|we're|ich|mir|mich|mein\w*|wir|uns|je|j'|moi|nous|mon|yo|mí|puedo|podemos|tengo|dispongo|debo|estoy)\b")
WILLING = re.compile(r"\b(?:can|cannot|could|able|unable|will|won|must|may|permitted|allowed|possible|d[eé]clin\w*|refus\w*|kann|können|darf|möglich|lage|muss|ablehn\w*|lehn\w*|peux|peut|pouvons|puis|mesure|permet\w*|autoris\w*|dois|puedo|puede|podemos|posible|rechaz\w*|permit\w*|autoriz\w*|debo)\b")
SAID = re.compile(r"\b(?:" + "|".join(sorted({w for ws in SPEECH.values() for w in ws})) + r"|answers|answering|answered|appropriate|lets?|allows?|guidelines?)\b")
DENIED = re.compile(r"\b(?:d[eé]clin\w*|refus\w*|ablehn\w*|lehne|rechaz\w*|unable|insufficient|impossible|insuffisante?s?|insuficientes?|unzureichend\w*)\b")
# Openings of an apology or of an assistant, and negations; both together refuse.
APOLOGIES = re.compile(r"\b(?:sorry|unfortunately|sadly|apologi[sz]e|regret|i'm afraid|automated assistant|language model|ai assistant|leider|tut mir leid|bedauer\w*|désolé\w*|malheureusement|regrett\w*|lo siento|lamento|por desgracia|lamentablemente)\b")
NEGATIONS = re.compile(r"\b(?:not?|cannot|never|nothing|none|unable|decline|nicht|kein\w*|nichts|ne|pas|aucune?|sin|ning\w+|nada)\b|n't\b")
# Thanks, advice and talk between the two speakers, and what a refusal names as its sources; such sentences answer nothing.
COURTESIES = re.compile(
    r"\b(?:thanks?|thank|please|kindly|understanding|understand|welcome|happy to|glad to|feel free|let me|anything else|consult|refer to|contact|i|i'm|i'd|i've|i'll|me|my|you|your|merci|veuillez|consultez|vous|votre|je|danke|bitte|ich|mir|ihnen|ihr|ihre[nr]?|wenden|gracias|por favor|consulte|usted|le ruego|su comprensión|yo|mi|grazie|prego)\b"
)
SOURCES = re.compile(r"\b(?:excerpts?|context|documents?|filings?|release|information|data|texts?|sources?|passages?|unterlagen|auszüge?|texte?n?|quellen?|informationen|extraits?|informations|documentos?|fuentes?|fragmentos?|información)\b")
# Frequent words of other languages than those of common_words.
OTHER_WORDS = {
    "it": "il lo gli che di del della dei delle nel nella non una per con sono è ha hanno al alla le ai dal sul più come anche questo i ed la un a e in da si tra fra su o cui".split(),
    "pt": "o os da do das dos em um uma que não para com por mais como foi são ao à pela pelo seu sua também entre no na e".split(),
    "nl": "de het een van en is dat op te in voor met niet zijn aan door ook bij naar werd wordt uit deze die over om als".split(),
    "sv": "och att det som en på är av för med den till inte har om ett från vid sin kan var men".split(),
    "da": "og at det som en på er af for med den til ikke har om et fra ved sin kan var men blev".split(),
    "pl": "i w na z do nie się że jest to o od za po przez dla oraz jak był są przy".split(),
}
# Words of those languages and of the usual ones of common_words that its short lists may leave out, among them those of amounts.
MORE_WORDS = {
    "en": "i no so but he she they their his been had will would than more into after about over during between million billion thousand dollars".split(),
    "de": "a am zum zur des einem einen einer eines sich war waren wurde wurden sind haben sein oder aber wie noch vor bis unter zwischen gegenüber durch gegen so sowie ab da er millionen milliarden mio mrd".split(),
    "fr": "il elle ils elles on se ce ces sa leur à y ou où ont été était sous entre contre après selon malgré aussi comme lors si mais l d s qu n millions milliards".split(),
    "es": "a e o u ante tras hasta según sin son han era eran fueron está están ser pero también donde cuando nos le les si ya millones millón dólares".split(),
    "it": "milioni miliardi dollari".split(), "pt": "a os as e se milhões bilhões dólares".split(), "nl": "miljoen miljard".split(),
    "sv": "miljoner miljarder".split(), "da": "millioner milliarder".split(), "pl": "milionów miliardów".split(),
}
# Short forms with a stop that do not end a sentence.
ABBREVIATIONS = frozenset("inc corp co ltd mio mrd tsd no nr vs approx incl u.s e.g i.e dr mr mrs ms st yr z.b d.h bzw ca ggf sr sra núm p.ej".split())

_CITED = re.compile(r"\s*(?:\[\d+\]\s*)+$")
_LETTERS = re.compile(r"[^\W\d_]+")
#: A metric or speaker named before the answer itself.
_LABEL = re.compile(r"^[^.:!?\n]{1,60}:\s+(?=\S)")
_FIGURE = re.compile(r"\d")
_AMOUNT = re.compile(r"\d+(?:[.,]\d+)*")
_NUMBERED = re.compile(r"^\s*(?:[-*+•]\s*)?\(?\d{1,3}[.)](?:\s+|$)")
_NO_FIGURES = re.compile(r"\[\d+\]|\b(?:8-k|10-[kq]|24/7|q[1-4]|20\d\d|19\d\d)\b")
# What may stand beside a figure that is an answer by itself.
_FIGURE_WORDS = re.compile(
    r"(?:usd|us|dollars?|eur|million(?:s|en)?|millones|billion|thousand|mio|mrd|tsd|milliards?|mil|de|dólares|percent|per|cent|pct|bps|basis|points?|q[1-4]|fy|h[12]|kwh|mwh|gwh|shares?|share|k|m|b|bn|mn|and|y|et|und|to|prozent|pour|cents?|about|approximately|ca|rund|environ|unos)$", re.I
)


class SuffixAutomaton:
    """All substrings of a text, by state; built in time linear in it."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.size[q] != self.size[p] + 1:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = clone
                    q = clone
                self.link[cur] = q
            last = cur

    def coverage(self, text: str, least: int) -> tuple[float, int]:
        """(share of the text inside common substrings of at least ``least``, the longest of them)."""
        state = length = covered = longest = 0
        upto = 0
        for i, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            else:
                length = 0
            if length >= least:
                covered += i - max(upto, i - length)
                upto = i
                longest = max(longest, length)
        return covered / max(1, len(text)), longest


@lru_cache(maxsize=4096)
def _automaton(question: str) -> SuffixAutomaton:
    return SuffixAutomaton(question)


@lru_cache(maxsize=1)
def _refusals() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    made = [f"{x} {y}" for lang, xs in UNABLE.items() for x in xs for y in SPEECH[lang]]
    for p in (*REFUSALS, *made):
        a.add_word(p, len(p))
    a.make_automaton()
    return a


def refuses(sentence: str) -> bool:
    """A sentence in lower case that declines: by a phrase, or by what it is made of.

    The latter is a negation or a denial together with two of: an apology, the one who
    speaks (with what it can or will), a verb of answering, the sources it speaks of.
    """
    if next(_refusals().iter(sentence), None) is not None:
        return True
    denied = bool(DENIED.search(sentence))
    if not denied and not NEGATIONS.search(sentence) and not BEYOND.search(sentence):
        return False
    sorry, speaker, said, source = bool(APOLOGIES.search(sentence)), bool(SPEAKER.search(sentence)), bool(SAID.search(sentence)), bool(SOURCES.search(sentence))
    if sorry or (speaker and denied):
        return True
    return sum((speaker, said, source, speaker and bool(WILLING.search(sentence)))) >= 2


def _plain(text: str) -> str:
    """Letters and figures only, in lower case, words set apart by one blank."""
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text).lower()))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    s = re.sub(r"<[^<>]*>", lambda m: " " if m.group().strip("</> ").lower() not in PLACEHOLDERS else m.group().strip("<>"), answer)
    s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Cc", "Zs") or c == " ").strip(" \t\r\n:;.,-–—_*#>|\"'`“”„«»()[]{}?!…/\\")
    return not any(c.isalnum() for c in s) or s.lower() in PLACEHOLDERS


def is_copy(question: str, answer: str) -> bool:
    q, a = _plain(question), _plain(answer)
    a = re.sub(r"^(?:(?:q|a|question|answer|frage|antwort|pregunta|respuesta|réponse)\s+)+", "", a)
    q = re.sub(r"^(?:(?:q|question|frage|pregunta)\s+)+", "", q)
    if not q or not a:
        return False
    covered, longest = _automaton(q).coverage(a, min(len(q), 12, max(6, len(q) // 4)))
    return covered >= 0.9 and longest >= 0.6 * len(q)


def is_refusal(answer: str, question: str | None = None) -> bool:
    """Refuses, and every other sentence is courtesy, advice or talk about the question; figures of the question and item numbers are no answer."""
    s = _CITED.sub("", answer.lower()).replace("’", "'").replace("ʼ", "'")
    asked = set(_AMOUNT.findall((question or "").lower()))
    declined = False
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", s):
        said = _NUMBERED.sub("", _NO_FIGURES.sub(" ", sentence))
        if not any(c.isalpha() for c in said) and not _FIGURE.search(said):
            continue
        if any(x not in asked for x in _AMOUNT.findall(said)):
            return False
        if refuses(sentence):
            declined = True
        elif not (sentence.rstrip().endswith("?") or APOLOGIES.search(sentence) or COURTESIES.search(sentence) or (SOURCES.search(sentence) and NEGATIONS.search(sentence))):
            return False
    return declined


def figure_alone(answer: str) -> bool:
    s = _CITED.sub("", answer.strip().strip("*_`").strip())
    words = [w for w in re.findall(r"[^\W_]+", s) if not any(c.isdigit() for c in w)]
    return bool(_FIGURE.search(s)) and all(_FIGURE_WORDS.match(w) for w in words) and s.rstrip()[-1:] not in ",:;(–-…" and not s.endswith("...")


_PAIRS = {")": "(", "]": "[", "}": "{", "»": "«"}


def _open_delimiters(text: str) -> bool:
    stack: list[str] = []
    for i, c in enumerate(text):
        if c in "([{«":
            stack.append(c)
        elif c in _PAIRS and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    return bool(stack) or text.count('"') % 2 == 1 or text.count("```") % 2 == 1


_NUMBERING = re.compile(r"(?m)(?:^|(?<=\s))\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})\)")
_SMILEY = re.compile(r"[:;]-?[()]")
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


def _left_open(text: str) -> bool:
    """A bracket, a quote of its own marks or a code fence is open at the end, whatever the last mark is.

    Inside code nothing counts, and a closer without its opener closes nothing; „ and « may be closed by several marks.
    """
    if text.count("```") % 2:
        return True
    s = re.sub(r"```.*?```|`[^`\n]*`", " ", text, flags=re.S)
    s = _NUMBERING.sub(" ", _SMILEY.sub(" ", s))
    stack: list[str] = []
    for c in s:
        if c in _CLOSERS:
            stack.append(c)
        elif stack and c == _CLOSERS[stack[-1]]:
            stack.pop()
    low = s.count("„")
    return bool(stack) or bool(re.search(r'(?:^|[\s(\[])"(?=\S)[^"]*$', s)) or (not low and s.count("“") > s.count("”")) or low > s.count("“") + s.count("”") or s.count("«") > s.count("»")


def is_truncated(answer: str) -> bool:
    s = answer.rstrip()
    if figure_alone(s):
        return False
    last = s.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:[-*+•|>#]+|\*\*|\(?[\da-zA-Z]{1,3}[.)]|\(|\[)?", last) and "\n" in s:
        return True
    body, cited = s, False
    while True:  # citations and closing quotes may follow each other
        less = _CITED.sub("", body).rstrip()
        cited |= less != body
        less = less.rstrip("\"'”“’»*_` ")
        if less == body:
            break
        body = less
    body = body or s
    if s.count('"') % 2 == 0 and body.count('"') % 2 == 1:
        body += '"'
    core = body.rstrip("\"'”“’»)]*_` ")
    if not core:
        return True
    if core.endswith(("…", "...")):
        return True
    if core[-1] in ".!?":
        tail = re.search(r"([^\W\d_][\w.]*)\.$", core)
        if tail and tail.group(1).lower() in ABBREVIATIONS and core[-1] == ".":
            return True
        return _left_open(s)
    if figure_alone(last):
        return False
    if "\n" in s and re.match(r"(?:[-*+•]|\d+[.)])\s", last):
        items = [x.strip() for x in s.split("\n") if re.match(r"\s*(?:[-*+•]|\d+[.)])\s", x)]
        if len(items) >= 2 and all(not re.search(r"[.!?][\"'”)\]]*(?:\s*\[\d+\])*$", x) for x in items[:-1]):
            return core[-1] in ",:;(–-" or _open_delimiters(body)
    return not cited or core[-1] in ",:;(–-" or _left_open(s)


class Votes:
    """Counts the frequent words of each language in a text."""

    def __init__(self, words: dict[str, tuple[str, ...]]):
        self.words = words
        self.of = lru_cache(10_000)(self._of)

    def _of(self, text: str) -> dict[str, int]:
        out: Counter = Counter()
        for w in _LETTERS.findall(text.lower()):
            for lang in self.words.get(w, ()):
                out[lang] += 1
        return dict(out)

    def between(self, one: str, two: str, text: str) -> tuple[int, int]:
        """How many words only the one, and only the other of two languages has; words of both decide nothing."""
        langs = [self.words.get(w, ()) for w in _LETTERS.findall(text.lower())]
        return sum(one in x and two not in x for x in langs), sum(two in x and one not in x for x in langs)


def _rather(other: str, own: str, text: str, votes: Votes) -> bool:
    """The words that only one of the two languages has clearly speak for ``other``."""
    theirs, ours = votes.between(other, own, text)
    return theirs >= 2 and theirs >= 2 * ours


def _script(text: str) -> str:
    kinds = Counter("cjk" if "぀" <= c <= "鿿" or "가" <= c <= "힯" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "arabic" if "֐" <= c <= "ۿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin" for c in text if c.isalpha())
    return kinds.most_common(1)[0][0] if kinds else ""


def other_language(question: str, answer: str, hint: str | None, votes: Votes) -> bool:
    if _script(question) and _script(answer) and _script(question) != _script(answer):
        return True
    asked = votes.of(question)
    best = max(asked.values(), default=0)
    mine = {lang for lang, n in asked.items() if n == best} if best else set()
    if len(mine) > 1 and hint in mine or not mine and hint:
        mine = {hint}
    if not mine:
        return False
    for text in {answer, _LABEL.sub("", answer)}:
        got = votes.of(text)
        most = max(got.get(own, 0) for own in mine)
        # a language with no more words in all has no more of its own either
        if any(n > most and all(_rather(other, own, text, votes) for own in mine) for other, n in got.items()):
            return True
    return False


def defect(question: str | None, answer: str | None, hint: str | None, votes: Votes) -> str | None:
    if is_empty(answer):
        return "empty"
    asked = bool(question and question.strip())
    if asked and is_copy(question, answer):
        return "copied_question"
    if is_refusal(answer, question):
        return "refusal"
    if (asked or hint) and other_language(question or "", answer, hint, votes):
        return "other_language"
    if is_truncated(answer):
        return "truncated"
    return None


def _defects(words: dict[str, tuple[str, ...]]):
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        votes = Votes(words)
        for question, answer, hint in batches:
            yield pd.Series([defect(q, a, h, votes) for q, a, h in zip(question, answer, hint, strict=True)], dtype=object)

    return run


def voters(common_words: DataFrame) -> dict[str, tuple[str, ...]]:
    """Languages of each frequent word."""
    rows = common_words.where(F.col("word").isNotNull() & F.col("lang").isNotNull()).select("lang", F.lower("word").alias("word")).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    out: dict[str, set[str]] = {}
    known = {r["lang"] for r in rows}
    fixed = [(x, w) for x, ws in OTHER_WORDS.items() if x not in known for w in ws] + [(x, w) for x, ws in MORE_WORDS.items() for w in ws]
    for lang, word in [(r["lang"], r["word"]) for r in rows] + fixed:
        out.setdefault(word, set()).add(lang)
    return {w: tuple(sorted(x)) for w, x in out.items()}


def defects(samples: DataFrame, results: DataFrame, common_words: DataFrame) -> DataFrame:
    """(pair_field, pair_id, defect) of every pair that has one."""
    find = F.pandas_udf(_defects(voters(common_words)), T.StringType())
    pairs = samples.select(F.lit("ground_truth").alias("pair_field"), F.col("sample_id").alias("pair_id"), "question", F.col("ground_truth").alias("answer"), F.lit(None).cast("string").alias("hint")).unionByName(
        results.select(F.lit("generated_answer").alias("pair_field"), F.col("result_id").alias("pair_id"), "question", F.col("generated_answer").alias("answer"), F.col("lang_hint").alias("hint"))
    )
    return (
        pairs.where(F.col("pair_id").isNotNull())
        .select("pair_field", "pair_id", find("question", "answer", "hint").alias("defect"))
        .where(F.col("defect").isNotNull())
        .distinct()
    )
