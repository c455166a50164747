"""Choice of a mock rule for a request, and the response that it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULE = (
    "session_id string, rule_id string, layer int, priority int, position int, direction string, service string, host string, method string,"
    " path string, path_prefix string, action string, status int, headers map<string,string>, body string"
)
#: Layers: the policy's own rule, the case's rules, the session's rules.
POLICY, CASE, SESSION = 0, 1, 2
_FIELDS = ("direction", "service", "host", "method", "path")


def requests_of(spans: DataFrame) -> DataFrame:
    """Lookups: the first span with ``sp.span.type`` = ``inject`` of each trace, with its matching fields."""
    a = lambda *keys: F.coalesce(*[F.when(F.trim(F.col("attributes")[k]) != "", F.col("attributes")[k]) for k in keys], F.lit(""))
    found = spans.where(F.col("attributes")["sp.span.type"] == "inject")
    first = F.row_number().over(Window.partitionBy("trace_id").orderBy("timestamp", "span_id"))
    return found.withColumn("__n", first).where("__n = 1").select(
        F.col("trace_id").alias("request_id"),
        "session_id",
        a("sp.traffic.direction").alias("direction"),
        F.when(a("sp.service.name") != "", a("sp.service.name")).otherwise(F.col("app_id")).alias("service"),
        a("url.host", "http.host").alias("host"),
        a("http.request.method", "http.method").alias("method"),
        a("url.path", "http.request.path", "http.target").alias("path"),
    )


def with_policies(rules: DataFrame, policies: DataFrame) -> DataFrame:
    """The rules and, for each session with a strict policy, one that matches whatever no other rule does.

    ``policies`` has session_id, strict (boolean), status and body.
    """
    strict = policies.where("strict").select(
        "session_id", F.lit("policy").alias("rule_id"), F.lit(POLICY).alias("layer"), F.lit(0).alias("priority"), F.lit(-1).alias("position"),
        *[F.lit("").alias(f) for f in (*_FIELDS, "path_prefix")], F.lit("error").alias("action"), "status",
        F.lit(None).cast("map<string,string>").alias("headers"), "body",
    )
    return rules.unionByName(strict)


def select_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Each request with its best rule, or nulls: highest priority, then layer, then latest position.

    A rule matches if each of its fields that is not empty equals the request's, and the path begins with its prefix.
    Rules meet requests by session, so no request meets the rules of others.
    """
    q, r = requests.alias("q"), rules.alias("r")
    fits = F.col("q.session_id") == F.col("r.session_id")
    for f in _FIELDS:
        fits &= (F.coalesce(F.col(f"r.{f}"), F.lit("")) == "") | (F.col(f"r.{f}") == F.col(f"q.{f}"))
    fits &= F.startswith(F.col("q.path"), F.coalesce(F.col("r.path_prefix"), F.lit("")))
    rank = F.struct("r.priority", "r.layer", "r.position", "r.rule_id")
    # Maps have no order, so the rule itself stays out of the comparison.
    best = q.join(r, fits).groupBy("q.request_id").agg(F.max_by(F.struct("r.*"), rank).alias("rule"))
    return requests.join(best, "request_id", "left")



def respond(selected: DataFrame) -> DataFrame:
    """request_id, outcome, status, body and strict_miss of selected rules.

    A mock's status 0 is 200, an error's 500. Pass-through, capture-only and no rule at all give 404; an action that is
    not known gives 500. Only an error that comes from the policy counts as a strict miss.
    """
    action, status = F.col("rule.action"), F.coalesce(F.col("rule.status"), F.lit(0))
    known = action.isin("mock", "error")
    code = (
        F.when(action == "mock", F.when(status == 0, 200).otherwise(status))
        .when(action == "error", F.when(status == 0, 500).otherwise(status))
        .when(F.col("rule").isNull() | action.isin("passthrough", "capture_only"), 404)
        .otherwise(500)
    )
    outcome = F.when(F.col("rule").isNull(), "none").otherwise(action)
    # A body that is a JSON text is sent as the text itself, any other as it stands.
    body = F.col("rule.body")
    plain = F.when(body.startswith('"') & body.endswith('"'), F.coalesce(F.from_json(F.concat(F.lit('{"v":'), body, F.lit("}")), "v string")["v"], body)).otherwise(body)
    return selected.select(
        "request_id", outcome.alias("outcome"), code.cast("int").alias("status"), F.when(known, plain).alias("body"),
        ((action == "error") & (F.col("rule.layer") == POLICY)).alias("strict_miss"),
    )
