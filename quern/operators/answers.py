"""Helpers of the answer path: hints, modes, the operations score, and what a model's reply holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Words of intent, hints that expand a query, and phrases that answer it.
CLUSTER, POD = ("klastr", "cluster"), ("pod", "pody", "pods")
INFO, RESOURCE = ("informac", "info", "sprawdz", "show", "check"), ("zasob", "resource", "resources")
LOGIN = ("auth", "oauth", "login", "użytkownik", "user")
HINTS = {
    "cluster": "OpenShift cluster information oc get all oc describe oc api-resources oc get nodes oc get clusterversion oc cluster-info",
    "pod": "OpenShift pods oc get pods oc describe pod kubectl get pods",
    "resource": "OpenShift resources oc get all oc api-resources oc describe",
}
CLUSTER_PHRASES = (
    "oc cluster-info", "oc get clusterversion", "oc get clusteroperators", "oc get nodes", "oc get all", "cluster version", "cluster operators",
    "health of nodes", "status and health of nodes",
)
POD_PHRASES = ("oc get pods", "oc describe pod", "pods in this project")


def hints(query: Column) -> Column:
    lower = F.lower(query)
    tests = {"cluster": X.any_in(lower, CLUSTER) & X.any_in(lower, INFO), "pod": X.any_in(lower, POD), "resource": X.any_in(lower, RESOURCE)}
    return F.array_compact(F.array(*[F.when(test, F.lit(HINTS[k])) for k, test in tests.items()]))


def mode(query: Column, wanted: Column) -> Column:
    """fast or smart: as wanted, else fast for short queries and questions."""
    wanted, lower = F.lower(F.coalesce(wanted, F.lit("auto"))), F.lower(query)
    return F.when(wanted.isin("fast", "smart"), wanted).when((F.length(query) < 40) | X.any_in(lower, ("jak", "co to", "komenda", "command")), "fast").otherwise("smart")


def operations_score(query: Column, content: Column) -> Column:
    lower, text = F.lower(query), F.lower(content)
    count = lambda phrases: sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0))
    cluster = F.when(X.any_in(lower, CLUSTER), 8 * count(CLUSTER_PHRASES) - F.when(F.contains(text, F.lit("oauth")) & ~X.any_in(lower, LOGIN), 12).otherwise(0)).otherwise(0)
    pods = F.when(X.any_in(lower, POD), 8 * count(POD_PHRASES)).otherwise(0)
    words = F.transform(F.split(F.trim(lower), r"(?U)\s+"), lambda w: F.btrim(w, F.lit(X.PUNCTUATION)))
    return cluster + pods + F.size(F.filter(words, lambda w: (F.length(w) >= 4) & F.contains(text, w)))


def prioritized(hits: DataFrame) -> DataFrame:
    """hits (query_id, query, content, ordinal) with priority: best operations score first, ties as they came."""
    rows = hits.withColumn("points", operations_score(F.col("query"), F.col("content")))
    return rows.withColumn("priority", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("points").desc(), "ordinal")))


def json_array(reply: Column, schema: str) -> Column:
    """The array in a model's reply, from the first [ to the last ]; empty where there is none or it can't be read."""
    return F.coalesce(F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), F.lit("")), f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def json_object(reply: Column, schema: str) -> Column:
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")), schema)
