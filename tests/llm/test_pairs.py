"""Defects of pairs, written by hand; the automaton against plain search."""

import random

import pytest

from quarrylight.llm import pairs

COMMON = {"en": "the of and to in a is that for it was".split(), "de": "der die das und in den von zu mit ist auf für im".split(), "fr": "le la les de des du et en un une est que a".split(), "es": "el la los las de y en un una es que".split()}


@pytest.fixture(scope="module")
def votes():
    words = {}
    for lang, ws in {**COMMON, **pairs.OTHER_WORDS}.items():
        for w in ws:
            words[w] = (*words.get(w, ()), lang)
    return pairs.Votes(words)


Q = "How much net income did the wholesale segment of Korvaz Mining report for Q1 2024?"


@pytest.mark.parametrize(
    "answer,want",
    [
        (None, "empty"), ("", "empty"), (" ​\xa0\n", "empty"), ("n/a", "empty"), ("<empty>", "empty"), ("[]", "empty"), ("A: ", "empty"), ("(no answer)", "empty"), ("…", "empty"), ("<br/>", "empty"),
        (Q, "copied_question"), (Q.upper(), "copied_question"), (f"> {Q}", "copied_question"), (f'"{Q[:-1]}."', "copied_question"), (f"{Q} {Q}", "copied_question"), (f"Question: {Q}", "copied_question"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("Unfortunately, this is not something I can look into. Please consult the filing.", "refusal"), ("Leider gilt: ich kann diese Frage nicht beantworten.", "refusal"), ("Lo siento, pero debo rechazar esta solicitud.", "refusal"),
        ("Le carnet de commandes de la division énergie atteint 5 millions de dollars, et la marge est de 4 %.", "other_language"), ("I ricavi del settore sono saliti del 15,8 % e hanno raggiunto 5 milioni di dollari nel periodo.", "other_language"),
        ("It was $5 million, and", "truncated"), ("It was $5 million. The wage bi", "truncated"), ("It was $5 million.\n2. ", "truncated"), ("It was $5 million.\n| ", "truncated"), ("The cost of…", "truncated"), ("According to Korvaz Mining Inc.", "truncated"), ("It was $5 million.\nThe ", "truncated"),
        ("$5 million", None), ("**$5.1 million** [1]", None), ("Q1 2024: $93,550,774", None), ("48 percent", None), ("It was $5 million.", None), ('"It was $5 million. [1]"', None), ("It was $5 million [2].", None),
        ("I could not find a quarterly number, yet the release gives $3 million for the year [1].", None), ("Sorry for the long answer: it came to $5 million.", None), ("1. It was $5 million.\n2. Sales rose.", None), ("In Q1 2024, the wholesale segment of Korvaz Mining reported net income of $5 million.", None),
    ],
)
def test_defects(votes, answer, want):
    assert pairs.defect(Q, answer, "en", votes) == want


def test_null_questions(votes):
    assert pairs.defect(None, "It was fine.", None, votes) is None
    assert pairs.defect("  ", "Le prix de la vente est de un million et la marge en est.", "en", votes) == "other_language"


def test_automaton():
    rnd = random.Random(2)
    for _ in range(200):
        q, a = ("".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        least = rnd.randint(1, 4)
        held = [False] * len(a)
        longest = 0
        for i in range(len(a)):
            for j in range(i + least, len(a) + 1):
                if a[i:j] in q:
                    held[i:j] = [True] * (j - i)
                    longest = max(longest, j - i)
        assert pairs.SuffixAutomaton(q).coverage(a, least) == (sum(held) / max(1, len(a)), longest)


def test_long_text():
    q = "word " * 20_000
    assert pairs.is_copy(q, q) and not pairs.is_copy(q, "other " * 20_000)


def test_operator(spark):
    samples = spark.createDataFrame([("s1", Q, ""), ("s1", Q, ""), ("s2", Q, "It was fine."), (None, Q, None)], "sample_id string, question string, ground_truth string")
    results = spark.createDataFrame([("r1", Q, Q, None), ("r2", None, None, "en"), ("r3", Q, "It rose.", "xx")], "result_id string, question string, generated_answer string, lang_hint string")
    common = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws] + [(None, "x"), ("en", None)], "lang string, word string")
    got = {tuple(r) for r in pairs.defects(samples, results, common).collect()}
    assert got == {("ground_truth", "s1", "empty"), ("generated_answer", "r1", "copied_question"), ("generated_answer", "r2", "empty")}
    assert pairs.defects(samples.limit(0), results.limit(0), common).count() == 0


@pytest.mark.parametrize(
    "question,answer,lang,want",
    [
        ("Qu'a dit Korvaz Mining sur les ventes de Hubrina ?", "Korvaz Mining prevé un resultado de entre 28,7 millones de dólares y 39,3 millones de dólares.", "fr", True),
        ("¿Cuáles fueron los ingresos de Korvaz Mining?", "Selon Korvaz Mining, les ventes de Vexaro ont progressé de 46,5 % pour atteindre 31,8 millions de dollars.", "es", True),
        ("Quelle prévision Korvaz Mining a-t-elle donnée ?", "La direzione prevede per Q4 un risultato compreso tra 1,7 milioni di dollari e 27,2 milioni di dollari.", "fr", True),
        (Q, "cost of sales: Für die Schließung von 123 Filialen in Asien wurden 740,3 Mio. USD zurückgestellt.", "en", True),
        (Q, "Korvaz Mining rechnet mit einem Ergebnis zwischen 127,7 Mio. USD und 127,4 Mio. USD.", "en", True),
        (Q, "Alcanzaron 183,2 millones.", "en", False),  # one word decides nothing
        ("¿Cuáles fueron los ingresos de Korvaz Mining?", "Alcanzaron 237,9 millones de dólares, frente a 3 millones.", "es", False),
        ("Quel a été le chiffre d'affaires ?", "Il a atteint 5 millions de dollars en Espagne, à la suite de la vente de un site.", "fr", False),
        (Q, "net income: It was $5 million in La Plata de Oro.", "en", False),
    ],
)
def test_sister_languages_and_labels(spark, question, answer, lang, want):
    common = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws], "lang string, word string")
    assert pairs.other_language(question, answer, lang, pairs.Votes(pairs.voters(common))) is want


@pytest.mark.parametrize(
    "answer,want",
    [
        ("Sales rose (driven by Asia. Costs fell.", True), ("Sales rose [see the table of the release. It was fine.", True), ('He said "sales rose. Costs fell.', True), ("He said “sales rose. Costs fell.", True), ("See:\n```\nx = 1.\n", True), ("Sales rose (driven by Asia [1]", True), ("Sales rose (driven by Asia. [1]", True), ("Er sagte „der Umsatz stieg. Die Kosten fielen.", True),
        ("Sales rose (driven by Asia).", False), ("Sales rose (driven by Asia) [1]", False), ("a) Sales rose. b) Costs fell.", False), ("(1) Sales rose. (2) Costs fell.", False), ("He said “sales rose.” Costs fell.", False), ("Er sagte „der Umsatz stieg“.", False), ("See `f(` there.", False), ("See:\n```\nf(x.\n```\nIt was fine.", False), ("Fine :( but it rose.", False), ('It needs a 5" pipe.', False),
    ],
)
def test_open_delimiters(answer, want):
    assert pairs.is_truncated(answer) is want


LONG = "I'm sorry, but I can't help with that request. " + "Thank you for your understanding and please consult the original filing of the company. " * 6


@pytest.mark.parametrize(
    "answer,want",
    [
        (LONG, True), (LONG + "Net income was $5 million.", False), (LONG + "Sales rose in Asia.", False), ("Sales rose in Asia. I cannot provide the margin.", False),
        ("1. I cannot answer this.\n2. Please consult the filing.", True), ("I cannot say whether it was 12.5 million. I am unable to help with this.", True), ("I am unable to help with this. It was 7 million.", False),
        ("Sales rose in Asia. " * 30 + "This is beyond my scope.", False),
    ],
)
def test_refusals_by_sentence(answer, want):
    assert pairs.is_refusal(answer, "Was net income 12.5 million?") is want


# written for this test, of words that no list holds as a phrase
HELD_OUT = [
    "I am sorry, that is nothing I could tell you.", "My rules do not let me say more about it.", "We are unable to speak to this matter.", "That lies outside the things I may comment on.",
    "Nothing in the excerpts helps me to determine it.", "I won't speculate about that.", "The passages hold no data from which I might answer.",
    "Dazu darf ich Ihnen leider nichts sagen.", "Ich bin nicht befugt, das zu beantworten.", "Die Unterlagen geben mir keine Antwort darauf.",
    "Je regrette de ne pas savoir vous aider.", "Nous ne sommes pas autorisés à donner cette réponse.", "Les documents ne me permettent pas de répondre.",
    "Lamento no saber qué responder.", "Los documentos no me dejan determinar la respuesta.", "No estoy en condiciones de decir eso.",
]
ANSWERS = [
    "The board did not change the outlook.", "Management said that demand was not affected.", "Export licences were refused for two product lines.", "Revenue fell because no new orders came in.",
    "The company cannot ship to the region before the licence is granted.", "Growth was beyond the plan in every region.", "Das Unternehmen hat keine neue Prognose genannt.", "La direction n'a pas relevé ses prévisions.",
    "La empresa no cambió sus previsiones.", "Nothing was said about dividends, while the buyback goes on.", "Unable to pass on higher costs, the segment lost share.",
]


def test_held_out_refusals():
    missed = [x for x in HELD_OUT if not pairs.is_refusal(x)]
    assert len(missed) <= 2, missed
    assert [x for x in ANSWERS if pairs.is_refusal(x)] == []


def test_no_caps():
    assert pairs.is_refusal("I am sorry, I cannot answer. " + "Please consult the filing itself for further detail. " * 50)
    assert pairs.is_copy("Why Q3?", "Why Q3?") and not pairs.is_copy("Why Q3?", "Because of Q3 demand.")
    assert pairs.figure_alone("about " * 30 + "$5 million")
