"""Scalar functions against hand-made rows."""

import random
import re

from pyspark.sql import functions as F

from quern import vocabulary as V
from quern.functions import scores as S
from quern.functions import text as X
from quern.operators import anchors, chunking


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_normalized(spark):
    assert one(spark, X.normalized(F.col("t")), t="  a \t b\r\n\n\nc  ") == "a b\nc"


def test_validity_edges(spark):
    ok = lambda t: one(spark, X.is_valid_chunk(F.col("t")), t=t)
    assert not ok("a" * 19) and ok("a" * 20)
    assert ok("a" * 12 + "!" * 8) and not ok("a" * 11 + "!" * 9)
    assert ok("zażółć gęślą jaźń abc")


def test_tags(spark):
    assert one(spark, X.hash_tags(F.col("t")), t="#Docker a#b #K8s #docker") == ["docker", "k8s"]
    assert one(spark, X.command_tags(F.col("t")), t="kubectl get pods; docker run; rhocp") == ["kubernetes", "cli", "docker", "containers", "openshift"]


def test_page(spark):
    assert one(spark, X.page_number(F.col("t")), t="## Page 7\ntext") == 7
    assert one(spark, X.page_number(F.col("t")), t="no page") is None


def test_search_terms(spark):
    query = "What is the RAG hybrid, konstytucja?"
    assert one(spark, X.search_terms(F.col("t")), t=query) == ["what", "rag", "hybrid", "konstytucja", "konstytucji", "constitution"]
    assert one(spark, X.search_terms(F.col("t"), {"what": ("why",)}, {"rag hybrid": ("both",)}), t=query)[::6] == ["why", "both"]


def test_variants(spark):
    assert set(one(spark, X.variants(F.col("t")), t="sejmie")) == {"sejmie", "sejm"}
    assert one(spark, X.variants(F.col("t")), t="dom") == ["dom"]


def test_graph_terms(spark):
    assert one(spark, X.graph_terms(F.col("t")), t="how does Red Hat OpenShift work") == ["how does Red Hat OpenShift work", "Red Hat OpenShift", "does", "openshift", "work"]


def test_relations_and_entities(spark):
    names = {"depends upon": None, "depends": "depends_on", "used_by": "uses", "Built-On": "builds_on", "likes": None}
    assert {k: one(spark, X.relation_name(F.col("t")), t=k) for k in names} == names
    ents = {"oc login": None, "10.4": None, "a/b": None, "foo_service": None, "k8s": "Kubernetes", "RHEL": "RHEL", "quay.io/x": "Quay.io/x", "dns of the api": "DNS of the API", "ABC": "ABC"}
    assert {k: one(spark, X.entity_name(F.col("t")), t=k) for k in ents} == ents


def test_urls(spark):
    url = lambda t: one(spark, X.canonical_url(F.col("t")), t=t)
    assert url("HTTPS://Ex.COM/a/#top") == "https://ex.com/a"
    assert url("https://ex.com") == "https://ex.com/"
    assert url("https://ex.com/a/?q=1") == "https://ex.com/a?q=1"
    scope = lambda t: one(spark, X.scope_prefix(F.col("t")), t=t)
    assert scope("https://ex.com/en/docs/x") == "/en/"
    assert scope("https://ex.com/a/b.html") == "/a/"
    can = lambda t: one(spark, X.is_crawlable(F.col("t"), F.lit("ex.com"), F.lit("/a/")), t=t)
    assert can("https://EX.com/a/b") and not can("https://ex.com/a/b.pdf") and not can("https://ex.com/c") and not can("ftp://ex.com/a/b")


def test_scores(spark):
    assert one(spark, S.l2(F.col("a"), F.col("b")), a=[0.0, 3.0], b=[4.0, 0.0]) == 5
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[4.0, 0.0]) == 0
    assert one(spark, S.graph_score(F.lit(4.0), F.lit("depends_on"), F.lit(1))) == 0.84
    assert abs(one(spark, S.live_score(F.lit(1.0))) - 0.5) < 1e-12


def test_quality(spark):
    q = lambda t: one(spark, X.low_quality(F.col("t")), t=t)
    assert q("  ") == 10 and q("A" * 40) == 20 and q("one two three") == 8 and q("these are five real words here") == 0


def test_windows():
    assert list(chunking.windows(" " * 5)) == []
    assert list(chunking.windows("a" * 1200)) == ["a" * 1200]
    got = list(chunking.windows("a" * 1201))
    assert got == ["a" * 1200, "a" * 201]
    text = " ".join(f"word{i}" for i in range(1000))
    parts = list(chunking.windows(text))
    assert all(len(p) <= 1200 for p in parts) and parts[0].startswith("word0") and parts[-1].endswith("word999")
    assert all(w in " ".join(parts) for w in text.split())


def test_markdown_and_code():
    parts = list(chunking.markdown("intro\n## One\n" + "x y " * 500 + "\n### no split\n## Two\nend"))
    assert parts[0] == "intro" and parts[1].startswith("## One") and parts[2].startswith("## One\n\n") and parts[-1] == "## Two\nend"
    assert list(chunking.code("import os\n\ndef a():\n    pass\n\nclass B:\n    pass\n", "m.py")) == [
        "## File: m.py\n\n### def a():\n\n```python\nimport os\n\ndef a():\n    pass\n```",
        "## File: m.py\n\n### class B:\n\n```python\nclass B:\n    pass\n```",
    ]
    assert list(chunking.code("a: 1\n---\nkind: Pod\nmetadata:\n  name: web\n", "x.yml"))[1].startswith("## File: x.yml\n\n### Pod web\n\n```yaml\n")
    assert [p.splitlines()[2] for p in chunking.code("select 1;\nselect\n2;\nrest", "q.sql")] == ["### SQL statement 1: select 1;", "### SQL statement 2: select", "### SQL statement 3: rest"]


def test_stripped_is_unicode_white_space(spark):
    """As the regular expression does it that it stands for."""
    chars = [(chr(c),) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(chars, "c string").select("c", F.concat("c", F.lit(" a"), "c", F.lit("b\n"), "c").alias("t"))
    assert rows.where(X.stripped(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert one(spark, X.stripped(F.col("t")), t=" 　\n") == "" and one(spark, X.stripped(F.lit(None).cast("string"))) is None


def test_first_lines(spark):
    """Only as many lines are split as are looked at."""
    for text in ("", "a", "a\r\nb\rc\n\nd\n", "\n\n", "\r\n\r", "a\n\rb\r\r\nc"):
        for n in (1, 2, 3, 160):
            assert one(spark, anchors.first_lines(F.col("t"), n), t=text) == re.split(r"\r\n|\n|\r", text)[:n]


def test_patterns_as_they_read(spark):
    """Normalising, validity, tags and sections are those of the plain patterns, on random texts."""
    draw = random.Random(5)
    parts = [" ", "  ", "\t", "\n", "\n\n", "\r\n", "#", "##", "## ", "a", "é", "ż", "ß", "7", "!", "_", "#Tag", "x#y", "é#no", "oc ", "doc ", "kubectl\t", "ansible-playbook", "ansible ", "rhocp", "Helm ", "-", "😀", "²", "\x85", "\xa0"]
    texts = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))) for i in range(600)] + [(600, None)]
    t, lower = F.col("t"), F.lower("t")
    norm = F.regexp_replace(F.regexp_replace(F.replace(X.stripped(t), F.lit("\r\n"), F.lit("\n")), "[ \t]+", " "), "\n+", "\n")
    special = F.length(F.regexp_replace(t, r"(?U)[\p{L}\p{N}\s]", ""))
    valid = (F.length(t) >= 20) & (special / F.greatest(F.length(t), F.lit(1)) <= 0.4)
    tags = X.clean_tags(F.regexp_extract_all(t, F.lit(r"(?U)(?<!\w)#([A-Za-z][A-Za-z0-9_-]*)"), 1))
    commands = F.array_distinct(F.flatten(F.array(*[F.when(F.rlike(lower, F.lit(p)), X.literals(w)).otherwise(F.array().cast("array<string>")) for p, w in V.COMMAND_TAGS])))
    pairs = [(X.normalized(t), norm), (X.is_valid_chunk(t), valid), (X.hash_tags(t), tags), (X.command_tags(t), commands)]
    rows = spark.createDataFrame(texts, "i int, t string")
    assert [r.t for r in rows.where(~F.array(*[a.eqNullSafe(b) for a, b in pairs]).eqNullSafe(F.array(*[F.lit(True)] * 4))).collect()] == []
    for _, text in texts[:600]:
        sections = [s.strip() for s in re.split(r"(?m)(?=^##\s+)", text) if s.strip()]
        assert [x.split("\n\n")[-1] for x in chunking.markdown(text)] == [x.split("\n\n")[-1] for x in sections]
