"""Anchors, entities and helpers of the answer path."""

from pyspark.sql import functions as F

from quern.operators import anchors, answers


def test_anchor_relations(spark):
    text = "2024-01-02\n# Red Hat Guide\nInstall OpenShift with Big Blue Button. big blue button again.\nNOTES HERE\n"
    docs = spark.createDataFrame([("a/guide_one.md", text), ("b/my-notes.txt", "x"), ("123.md", None)], "source string, text string")
    rows = {(r.source, r.relation, r.target, r.document) for r in anchors.relations(docs).collect()}
    of = lambda d: {(r[0], r[1], r[2]) for r in rows if r[3] == d}
    got = of("a/guide_one.md")
    assert ("Red Hat Guide", "is_a", "dokument") in got and ("Red Hat Guide", "contains", "Big Blue Button") in got and ("Red Hat Guide", "contains", "OpenShift") in got
    assert of("b/my-notes.txt") == {("my notes", "is_a", "dokument")} and of("123.md") == {("123.md", "is_a", "dokument")}


def test_legal_document(spark):
    docs = spark.createDataFrame([("k.pdf", "KONSTYTUCJA RZECZYPOSPOLITEJ POLSKIEJ\nSejm i Senat")], "source string, text string")
    got = {(r.relation, r.target) for r in anchors.relations(docs).collect()}
    assert {("is_a", "dokument"), ("is_a", "akt normatywny"), ("contains", "Sejm"), ("contains", "Senat")} <= got


def test_answer_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert len(one(answers.hints(F.lit("show cluster pods and resources")))) == 3
    assert one(answers.mode(F.lit("x" * 50), F.lit("auto"))) == "smart" and one(answers.mode(F.lit("short"), F.lit(None).cast("string"))) == "fast"
    assert one(answers.operations_score(F.lit("cluster state"), F.lit("run oc get nodes; oauth state"))) == 8 - 12 + 1
    assert one(answers.json_array(F.lit('text [{"a": 1}] end'), "struct<a:int>"))[0].a == 1 and one(answers.json_array(F.lit("none"), "struct<a:int>")) == []
    assert one(answers.json_object(F.lit('x {"b": 2} y'), "b int")).b == 2
