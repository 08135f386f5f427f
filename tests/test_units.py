"""Amounts written by hand, then the operator over records with nulls and hints."""

import pytest

from quarrylight.operators import units


@pytest.mark.parametrize(
    "quantity,key,text,said,hint,want",
    [
        ("money", "value", "$1,433,219,838", [], None, 1433219838),
        ("money", "value", "($793,112,844)", [], None, -793112844),
        ("money", "prior_value", "79584,65 Mio. USD", [], None, 79584650000),
        ("money", "value", "34,7 milliards de dollars", [], None, 34700000000),
        ("money", "value", "4.576.707,1 Tsd. USD", [], None, 4576707100),
        ("money", "value", "1 234,5 millions de dollars", [], None, 1234500000),
        ("money", "value", "2.07e10 USD", [], None, 20700000000),
        ("money", "value", "−$471,455K", [], "millions", -471455000),
        ("money", "value", "US$30,528MM", [], None, 30528000000),
        ("money", "value", "6,199.61", ["", "millions", "USD"], None, 6199610000),
        ("money", "value", "66.852", ["", "B of US dollars"], None, 66852000000),
        ("money", "value", "3652722.5", ["", "figures in thousands of US dollars"], None, 3652722500),
        ("money", "value", "998,361,999", ["", "units", "USD"], "thousands", 998361999),
        ("money", "value", "88,249.1", [""], "millions", 88249100000),
        ("money", "value", "about 17,164", ["", "as reported"], "thousands", 17164000),
        ("money", "value_usd_bn", "43.0", [" usd bn"], None, 43000000000),
        ("ratio", "value", "564.40‰", [], None, 5644),
        ("ratio", "value", "37,88 %", [], None, 3788),
        ("ratio", "value", "−0.3892", ["", "ratio"], None, -3892),
        ("ratio", "value", "0.16", ["", "per cent"], None, 16),
        ("ratio", "value", "6,119 basis points", [], None, 6119),
        ("money", "change", "(9.9)%", [], None, -990),
        ("per_share", "value", "$16.42/share", [], None, 1642),
        ("per_share", "value", "(997 cents)", [], None, -997),
        ("per_share", "value", "0.62", ["", "$ per diluted share"], None, 62),
        ("energy", "value", "60,039GJ", [], None, 16677500),
        ("energy", "value", "35,127 megawatt hours", [], None, 35127000),
        ("area", "value", "about 92,778 ft²", [], None, 8619),
        ("area", "value", "67,205", ["", "M²"], None, 67205),
        ("area", "value", "21.24", ["", "ha"], None, 212400),
        ("mass", "value", "about 576,766 pounds", [], None, 261617),
        ("mass", "value", "3,039.6", ["", "t"], None, 3039600),
        ("mass", "value", "about 16,762.7 tonnes CO2e", [], None, 16762700),
        ("count", "value", "4990", ["", "hundreds"], None, 499000),
        ("count", "value", "54.88 M", [], None, 54880000),
        ("count", "value", "508320", [""], "millions", 508320),
        ("money", "value", "see note 4", [], None, None),
        ("money", "value", "record high", [], "millions", None),
        ("money", "value", "—", [], None, None),
        ("money", "value", "12 kWh", [], None, None),
        ("money", "value", None, [], None, None),
        (None, "value", "12", [], None, None),
        ("money", "value", "9" * 40, [], None, None),
        ("money", "value", "1 million to 2 million", [], None, None),
    ],
)
def test_amounts(quantity, key, text, said, hint, want):
    assert units.base_value(quantity, key, text, said, hint) == want


def test_operator(spark):
    ents = spark.createDataFrame(
        [
            (1, " Net  Revenue", "METRIC", ["c0", "c1"], {"value": "5", "basis": "gaap", "weight": "3"}),
            (2, "net revenue", "METRIC", None, {"value": "5", "unit": "USD mn", "change": "1 %"}),
            (3, "net revenue", "METRIC", ["c1"], None),
            (4, "unknown metric", "METRIC", ["c1"], {"value": "5"}),
            (5, None, "METRIC", ["c1"], {"value": "5"}),
            (6, "net revenue", "PERSON", ["c1"], {"value": "5"}),
            (7, "headcount", "METRIC", [None], {"value": "12", "prior_value": None}),
        ],
        "entity_id bigint, name string, entity_type string, chunk_ids array<string>, properties map<string,string>",
    )
    rels = spark.createDataFrame([(1, "net revenue", "REPORTS", None, {"prior_value": "7"}), (2, "net revenue", "MAKES", "c1", {"value": "7"})], "rel_id bigint, source string, relation string, chunk_id string, properties map<string,string>")
    chunks = spark.createDataFrame([("c1", "x (dollars in thousands)"), ("c1", "x (dollars in thousands)"), ("c0", None), (None, "in millions")], "chunk_id string, text string")
    common = spark.createDataFrame([("net revenue", "money", "US dollar"), ("headcount", "count", "single unit")], "metric string, quantity string, base_unit string")
    out = {tuple(r) for r in units.amounts(ents, rels, chunks, common).collect()}
    assert out == {("entities", 1, "value", 5000), ("entities", 2, "value", 5000000), ("entities", 2, "change", 100), ("entities", 7, "value", 12), ("relationships", 1, "prior_value", 7)}
    assert units.amounts(ents.limit(0), rels.limit(0), chunks, common).count() == 0


def test_long_texts():
    assert units.base_value("money", "value", "$5" + " " * 300 + "million", [], None) == 5_000_000
    assert units.base_value("money", "value", "$5 million " + "as the company said in its release " * 20, [], None) is None
    assert units.base_value("money", "value", "word " * 20_000 + "7", [], None) is None


@pytest.mark.parametrize(
    "quantity,text,base,want",
    [
        ("rate", "$12 per kWh", "US cent per kilowatt-hour", 1200),
        ("rate", "12 dollars per MWh", "US cent per kilowatt-hour", 1),
        ("rate", "5 million dollars per tonne", "US dollar per kilogram", 5000),
        ("money", "$12 per kWh", None, None),
        ("money", "12 dollars per share", None, None),
        ("money", "dollars per tonne 5", None, None),
        ("energy", "3 kilowatt hours", None, 3),
        ("energy", "3 megawatt-hours", None, 3000),
        ("energy", "3 MW", None, None),
        ("energy", "7.2 megajoules", None, 2),
        ("power", "36 MWh per hour", "kilowatt", 36000),
        ("area", "3 km²", None, 3000000),
        ("area", "10 square feet", None, 1),
        ("area", "1000 ft^2", None, 93),
        ("area", "100 sq. yd", None, 84),
        ("area", "10 feet", None, None),
        ("volume", "2 cubic metres", "cubic metre", 2),
        ("volume", "1000 ft³", "cubic metre", 28),
        ("volume", "3 metres * metre * metre", "cubic metre", 3),
        ("heat", "20 °C", "kelvin", 293),
        ("heat", "68 °F", "degree celsius", 20),
        ("heat", "300 kelvin", "celsius", 27),
        ("heat", "−40 degrees Fahrenheit", "celsius", -40),
        ("per_share", "$3 per thousand shares", None, 0),
        ("per_share", "300 cents a share", None, None),
        ("money", "5", "no such unit", None),
        ("money", "5 thousand", "thousand US dollars", 5000),
    ],
)
def test_algebra(quantity, text, base, want):
    assert units.base_value(quantity, "value", text, [], None, base) == want
