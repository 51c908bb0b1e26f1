"""Worked examples of the scalar functions."""

from pyspark.sql import functions as F
from quarry.functions import constants as C
from quarry.functions import text as T
from quarry.sources import readers as I


def applied(spark, function, values):
    """function over a column of values, in their order."""
    rows = spark.createDataFrame(list(enumerate(values)), "at int, v string")
    return [r.out for r in rows.select("at", function(F.col("v")).alias("out")).orderBy("at").collect()]


def test_organisations(spark):
    want = [
        ("Global  Insurance Co", "Global  Insurance Co", "", "international", "InsuranceCompany", "sg:Org_global_insurance_co", False),
        ("Bureau of Statistics (Lao PDR)", "Bureau of Statistics", "Lao PDR", "public", "StatisticalOffice", "sg:Org_bureau_of_statistics_lao_pdr", False),
        ("University of X", "University of X", "", "private", "University", "sg:Org_university_of_x", True),
        ("UNDP", "UNDP", "", "unknown", "UNAgency", "sg:Org_undp", False),
        ("Nobody", "Nobody", "", "unknown", "org:Organization", "sg:Org_nobody", False),
    ]
    whole = lambda n: F.struct(n, T.base_name(n), T.country_of(n), T.organisation_type(n), T.organisation_class(n, T.organisation_type(n)), T.organisation_uri(n), T.needs_country(n))
    assert [tuple(r) for r in applied(spark, whole, [w[0] for w in want])] == want


def test_names_and_concepts(spark):
    names = {"Min of  Health, ": "Ministry of Health", "Natl Univ of X (Y)": "National University of X", "Intl Org Ltd": "International Organization Limited", "Dept of Gov": "Department of Government"}
    assert applied(spark, T.normalise_organisation, names) == list(names.values())
    concepts = {"Increased Penetration": "Increase Penetration", "Leveraging Tech": "Leveraging Technology", "A Risk B": None, "Raising  Awareness": "Raising Awareness", "Reduced Penetration": "Reduce Penetration", "Accessibilty": "Accessibility"}
    assert applied(spark, T.normalise_concept, concepts) == list(concepts.values())
    assert applied(spark, T.clean_organisation, [" A  b.,", "NIL", "n/a", "x;", ".,;"]) == ["A b", None, None, "x", None]


def test_minted_uris(spark):
    want = {
        ("PERSON", "Dr. Ada Lovelace"): "kr:person/ada_lovelace", ("PERSON", "Prof Mr. X"): "kr:person/x", ("ORGANIZATION", "World Bank"): "kr:organization/world_bank",
        ("ORGANIZATION", "IPCC"): "kr:organization/ipcc", ("ORGANIZATION", "Some Other  Body, Inc."): "kr:organization/some_other_body_inc",
        ("LOCATION", "Kuala Lumpur"): "kr:location/kuala_lumpur", ("DATE", "12 May 2020"): "kr:date/12_may_2020", ("NATURAL_EVENT", "Flood of 1953"): "kr:naturalevent/flood_of_1953",
    }
    rows = spark.createDataFrame([*want], "kind string, text string")
    assert {(r.kind, r.text): r.uri for r in rows.select("kind", "text", T.mint_uri(F.col("kind"), F.col("text")).alias("uri")).collect()} == want


def test_uris_and_values(spark):
    assert applied(spark, T.expand_curie, [f"{p}:Thing" for p in C.PREFIXES]) == [f"{s}Thing" for s in C.PREFIXES.values()]
    assert applied(spark, T.camel_label, ["sg:FloodRisk", "Plain"]) == ["Flood Risk", "Plain"]
    assert applied(spark, T.sanitise_uri, ["sg:FloodRisk", "sg:Early Warning(System)", "Plain", "sg:()"]) == ["sg:FloodRisk", "sg:EarlyWarningSystem", "sg:Plain", "sg:Unknown"]
    kinds = ["Risk Reduction, Insurance", "Capital funding", "Something else", ""]
    assert applied(spark, T.categories, kinds) == [["risk reduction", "insurance penetration"], ["risk financing"], ["risk reduction"], []]
    values = ["12.5, 99", "91,0", "TRUE", "1.0", "-0", "1e3", "9223372036854775808", "12.00", "en-GB", "", "abc"]
    assert applied(spark, T.is_geo_point, values).count(True) == 1
    assert [v for v, x in zip(values, applied(spark, T.is_long, values)) if x] == ["1.0", "-0", "12.00"]
    assert [v for v, x in zip(values, applied(spark, T.is_double, values)) if x] == ["1.0", "-0", "1e3", "9223372036854775808", "12.00"]


def test_scripts(spark):
    text = "# c\nPREFIX a: <b>\nINSERT DATA { x } ;\nPREFIX c: <d>\nDELETE { y }"
    scripts = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, script string")
    got = sorted(map(tuple, I.script_requests(scripts, "id", "script").collect()))
    assert got == [(1, 0, "PREFIX a: <b>\nINSERT DATA { x }"), (1, 1, "PREFIX a: <b>\nPREFIX c: <d>\nDELETE { y }")]
