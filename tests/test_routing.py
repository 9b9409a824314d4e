from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doccat.config import ERROR_CODES, KEPT_CODES, REPLACED_CODES, Settings
from doccat.operators.routing import route_inbox, route_plan
from doccat.operators.triage import triage_results

DATED = "m/Musterfrau_Klara_09.11.1968/2021-03-08_Befund_Labor_Nord.pdf"
PLAIN = "m/Musterfrau_Klara_09.11.1968/Befund_Labor_Nord.pdf"
NAMES = [
    ("2021-03-08_Musterfrau_Klara_09.11.1968_Befund Labor Nord.pdf", 0, DATED),
    ("2021_03_08-Musterfrau-Klara-09-11-1968 Befund Labor Nord.pdf", 0, DATED),
    ("Musterfrau_Klara_09.11.1968_Befund Labor Nord.pdf", 1, PLAIN),
    ("Musterfrau-Klara-09-11-1968-Befund Labor Nord.pdf", 1, PLAIN),
    ("2021-03-08_Musterfrau_Klara_1968.11.09_Befund Labor Nord.pdf", 2, DATED),
    ("2021_03_08_Musterfrau-Klara-1968-11-09-Befund Labor Nord.pdf", 2, DATED),
    ("Musterfrau_Klara_1968.11.09_Befund Labor Nord.pdf", 3, PLAIN),
    ("Musterfrau-Klara-1968-11-09-Befund Labor Nord.pdf", 3, PLAIN),
    ("Musterfrau_Klara__Befund Labor Nord.pdf", None, None),
    # no title: the whole match names the file
    ("Doe_Jo_01.02.2000.pdf", 1, "d/Doe_Jo_01.02.2000/Doe_Jo_01.02.2000.pdf"),
    ("2021-03-08_Doe_Jo_01.02.2000.odt", 0, "d/Doe_Jo_01.02.2000/2021-03-08_.odt"),
    ("Äb_Jo_01.02.2000_x y.tar.gz", 1, "ä/Äb_Jo_01.02.2000/x_y.tar.gz"),
]


def test_names(spark):
    files = spark.createDataFrame([(f"/aaa_inbox/{n}",) for n, _, _ in NAMES], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.rule, r.placed) for r in route_inbox(files).collect()}
    assert got == {n: (rule, placed) for n, rule, placed in NAMES}


def test_own_rules(spark):
    own = Settings(rules=((r"^(\w+) (.+)$", "title,lastname"), (r"(x)", "date")), concern_prefix_length=0)
    files = spark.createDataFrame([("/i/letter Doe.txt",), ("/i/axb.txt",), ("/i/nope.txt",)], "path string")
    got = [(r.rule, r.placed) for r in route_inbox(files, own).collect()]
    assert got == [(0, "Doe/letter.txt"), (1, "/x.txt"), (None, None)]


def test_plan(spark):
    paths = ["/docs/aaa_inbox/Doe_Jo_01.02.2000_a.pdf", "/docs/aaa_inbox/scan.pdf", "/docs/d/b.pdf", "/docs/aaa_inbox/sub/c.pdf"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [(r.action, r.destination) for r in route_plan(files, Settings(root="/docs")).collect()]
    assert got == [
        ("move", "d/Doe_Jo_01.02.2000/a.pdf"),
        ("manual", "aaa_manuell/scan.pdf"),
        ("index", "d/b.pdf"),
        ("index", "aaa_inbox/sub/c.pdf"),
    ]


@pytest.mark.parametrize("codes, outcome", [(REPLACED_CODES, "replaced"), (KEPT_CODES, "kept"), ((*ERROR_CODES, 77), "error")])
def test_triage(spark, codes, outcome):
    rows = triage_results(spark.createDataFrame([(c,) for c in codes], "code int")).collect()
    assert {r.outcome for r in rows} == {outcome}
    assert all(r.known_code == (r.code != 77) for r in rows)


def test_no_codegen_fallback(spark):
    """Routing compiles: its plan runs inside whole-stage code."""
    files = spark.createDataFrame([(f"/aaa_inbox/{n}",) for n, _, _ in NAMES], "path string")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        assert route_inbox(files).where(F.col("rule").isNotNull()).count() == 11
    finally:
        spark.conf.unset("spark.sql.codegen.factoryMode")
