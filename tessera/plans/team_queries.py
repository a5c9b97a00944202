"""Rounds over dependency graphs and flows of model calls with scripted replies."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import replies, report_flows, team, templates
from tessera.operators.records import ordered_list
from tessera.plans.base import query
from tessera.streaming import lifecycles

Q = F.col
MODULUS = 1_000_003


def planner(prompts: list[str]) -> list[str]:
    """A scripted planner: some sections have no plan, some are done after one, some have a step that waits for nothing known."""
    out = []
    for p in map(json.loads, prompts):
        x, k = int(p["title"]), p["plan"]
        first = (x + k + sum(int(b) for b in p["background"])) % MODULUS
        steps = [{"id": f"{k}-1", "title": str(first)}, {"id": f"{k}-2", "title": "2", "parent_ids": [f"{k}-1"]}]
        steps += [{"id": f"{k}-3", "title": "3", "parent_ids": [f"{k}-1", "none"]}] if x % 5 == 0 else []
        done = k == 1 and x % 2 == 0
        out.append("no plan" if x % 11 == 0 else json.dumps({"title": "t", "is_research_completed": done, "steps": [] if done else steps}))
    return out


def collector(prompts: list[str]) -> list[str]:
    """A scripted collector: a step's title and background, added up."""
    return [json.dumps({"info_summary": str((int(p["title"]) + sum(int(b) for b in p["background"])) % MODULUS)}) for p in map(json.loads, prompts)]


def total(results):
    return (F.aggregate(results, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) % MODULUS).cast("string")


def order_outlines(t):
    """An outline for each customer: their orders are sections; of three orders each depends on those before it."""
    n = F.row_number().over(team_window().partitionBy("o_custkey").orderBy("o_orderkey"))
    lines = t("orders").select(Q("o_custkey").alias("outline_id"), n.alias("n"), (Q("o_orderkey") % 1000).cast("string").alias("title"))
    first = Q("n") - (Q("n") - 1) % 3
    parents = F.when(Q("n") > first, F.transform(F.sequence(first, Q("n") - 1), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    return lines.select("outline_id", Q("n").cast("string").alias("id"), "title", parents.alias("parent_ids"))


def team_window():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


@query(f"""
WITH RECURSIVE s AS (SELECT o_custkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 1000 AS x FROM orders),
w AS (
  SELECT o, n, x, CAST(0 AS BIGINT) AS bg, CASE WHEN x % 11 = 0 THEN 0 ELSE (x * 2 + 2 + CASE WHEN x % 2 = 1 THEN (x + 1) * 2 + 2 ELSE 0 END) % {MODULUS} END AS v FROM s WHERE (n - 1) % 3 = 0
  UNION ALL
  SELECT o, n, x, b, CASE WHEN x % 11 = 0 THEN 0 ELSE (2 * ((x + b) % {MODULUS}) + 2 + CASE WHEN x % 2 = 1 THEN 2 * ((x + b + 1) % {MODULUS}) + 2 ELSE 0 END) % {MODULUS} END
  FROM (SELECT s.o, s.n, s.x, w.bg + w.v AS b FROM w JOIN s ON s.o = w.o AND s.n = w.n + 1 WHERE (s.n - 1) % 3 > 0) AS y)
SELECT o AS outline_id, CAST(n AS VARCHAR) AS id, CAST(v AS VARCHAR) AS result, CASE WHEN x % 11 = 0 THEN 'failed' WHEN x % 2 = 0 THEN 'completed' ELSE 'limit' END AS status,
  CASE WHEN x % 11 = 0 THEN 0 WHEN x % 2 = 0 THEN 1 ELSE 2 END AS plans, CAST((n - 1) % 3 AS INTEGER) AS round FROM w""")
def outline_research(t):
    """Sections researched as their parents allow, each with up to two plans of dependent steps; every customer is an outline."""
    done = team.outline_research(order_outlines(t), planner, lambda steps: team.collected(steps, collector), value=total)
    return done.select("outline_id", "id", "result", "status", "plans", "round")


@query("""
SELECT l_orderkey AS outline_id, CAST(l_partkey AS VARCHAR) AS id, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN 0 ELSE 1 END AS round FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) AS x
UNION ALL SELECT DISTINCT l_orderkey, 'root', 0 FROM lineitem""")
def blocked_steps(t):
    """Items that wait for a root, for nothing, or for something unknown."""
    own = t("lineitem").select(Q("l_orderkey").alias("outline_id"), Q("l_partkey").alias("p")).distinct()
    waits = F.when(Q("p") % 5 == 0, F.array(F.lit("root"), F.lit("unknown"))).when(Q("p") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("root")))
    items = own.select("outline_id", Q("p").cast("string").alias("id"), waits.alias("parent_ids"))
    roots = own.select("outline_id").distinct().select("outline_id", F.lit("root").alias("id"), F.array().cast("array<string>").alias("parent_ids"))
    done = team.ready_rounds(items.unionByName(roots), lambda r: r.select("outline_id", "id", F.lit("x").alias("result")), ["outline_id"])
    return done.select("outline_id", "id", "round")


def classifier(prompts: list[str]) -> list[str]:
    """Names the documents of even parts; some sections get no reply that can be read, some no document."""
    out = []
    for p in map(json.loads, prompts):
        key = int(p["report_id"])
        out.append("oops" if key % 13 == 0 else json.dumps({"core_content_url_list": [] if key % 11 == 0 else [d["url"] for d in p["docs"] if int(d["title"]) % 2 == 0]}))
    return out


def outliner(prompts: list[str]) -> list[str]:
    """An outline of valid form, for some sections only at the third attempt, for some never."""
    out = []
    for p in map(json.loads, prompts):
        key, n = int(p["of"]["report_id"]), p["of"]["section"]
        good = key % 7 or p["attempt"] == 2 and key % 5
        out.append(f"{n}. Title\n{n}.1 part\n{n}.2 part" if good else f"{n}. Title")
    return out


def writer(prompts: list[str]) -> list[str]:
    """How many documents and charts a section has; some get no text."""
    asked = [json.loads(p)["of"] for p in prompts]
    return ["" if int(p["report_id"]) % 17 == 0 else f"{p['report_id']}.{p['section']}: {len(p['docs'])} and {len(p['charts'])}" for p in asked]


@query("""
WITH i AS (SELECT l_orderkey AS o, l_linenumber % 2 + 1 AS section, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
u AS (SELECT o, section, p % 20 AS u, arg_max(p, n) AS p, bool_or(p % 2 = 0) AS named FROM i GROUP BY ALL),
d AS (SELECT o, section, count(*) FILTER (named) AS docs, count(*) FILTER (named AND p % 3 = 0) AS charts FROM u GROUP BY ALL),
s AS (SELECT o_orderkey AS o, unnest([1, 2]) AS section FROM orders),
r AS (SELECT s.o, s.section, coalesce(docs, 0) AS docs, coalesce(charts, 0) AS charts, CASE WHEN docs IS NULL THEN 'no documents' WHEN s.o % 13 = 0 THEN 'classification failed' WHEN s.o % 11 = 0 OR docs = 0 THEN 'no documents chosen'
  WHEN s.o % 7 = 0 AND s.o % 5 = 0 THEN 'outline failed' WHEN s.o % 17 = 0 THEN 'text failed' END AS error FROM s LEFT JOIN d ON s.o = d.o AND s.section = d.section)
SELECT CAST(o AS VARCHAR) AS report_id, CAST(section AS INTEGER) AS section, error, CASE WHEN error IS NULL THEN o || '.' || section || ': ' || docs || ' and ' || charts END AS text,
  CAST(CASE WHEN error IN ('no documents', 'classification failed', 'no documents chosen') THEN 0 ELSE docs END AS INTEGER) AS docs FROM r""")
def section_reports(t):
    """Two sections for each order, over its lines as documents; a third of them has numbers for a chart."""
    numbers = '{"image_title": "t", "image_type": "bar", "unit": "u", "records": [["a", "1", "x"], ["b", "2", "x"], ["c", "4", "x"]]}'
    content = F.when(Q("l_partkey") % 3 == 0, numbers).otherwise("no numbers")
    lines = t("lineitem").select(Q("l_orderkey").cast("string").alias("report_id"), (Q("l_linenumber") % 2 + 1).cast("int").alias("section"), "l_linenumber", "l_partkey", "l_suppkey")
    pos = F.row_number().over(team_window().partitionBy("report_id", "section")) - 1  # dealt by section, so that grouping them for calls needs no other shuffle
    docs = lines.select("report_id", "section", pos.alias("pos"), F.format_string("u%d", Q("l_partkey") % 20).alias("url"), Q("l_partkey").cast("string").alias("title"), content.alias("content"))
    sections = t("orders").select(Q("o_orderkey").cast("string").alias("report_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("section"), F.lit("T").alias("title"))
    made = report_flows.section_reports(sections, docs, {"classify": classifier, "section_outline": outliner, "section_report": writer})
    return made.select("report_id", "section", "error", "text", F.size("docs").alias("docs"))


def scripted(stage: int, reply):
    """A client that fails for the conclusions whose number leaves `stage` by 9, and else replies."""
    return lambda prompts: ["?" if int(p["inference_id"]) % 9 == stage else json.dumps(reply(p)) for p in map(json.loads, prompts)]


def structured(p: dict) -> dict:
    """Records to a middle statement to the conclusion; for some a ghost without ground, for some an island, for some two conclusions or a loop."""
    k = int(p["inference_id"])
    edge = lambda heads, tail: {"heads": heads, "relation": "r", "tail": tail}
    out = [edge(["0", "1"], f"the middle statement of {k}"), edge([f"the middle statement of {k}"], p["conclusion"])]
    out += [edge(["a ghost without any ground"], p["conclusion"])] if k % 2 == 0 else []
    out += [edge(["2"], "an island far away from all")] if k % 3 == 0 else []
    out += [edge([p["conclusion"]], "zzzz")] if k % 5 == 0 else []
    out += [edge([f"the middle statement of {k}"], f"the middle statement of {k}")] if k % 7 == 0 else []
    return {"edges": out}


def joined_islands(p: dict) -> dict:
    """Joins the last statement of the island to the middle, for every second one asked about."""
    k, names = int(p["inference_id"]), {n["label"]: str(n["id"]) for part in p["parts"] for n in part}
    island = names["an island far away from all"]
    return {"edges": [{"heads": [island], "relation": "b", "tail": names[f"the middle statement of {k}"]}] if k % 2 else []}


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT c.k, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'nothing to infer from' WHEN c.k % 9 = 1 THEN 'no evidence' WHEN c.k % 9 = 2 THEN 'no inference' WHEN c.k % 9 = 3 THEN 'void inference' WHEN c.k % 9 = 4 THEN 'no structure'
  WHEN c.k % 5 = 0 THEN 'not one conclusion' END AS dropped FROM c LEFT JOIN o ON c.k = o.k)
SELECT CAST(k AS VARCHAR) AS inference_id, dropped, CASE WHEN dropped IS NULL OR dropped = 'not one conclusion' THEN 'because ' || k END AS inference,
  CAST(CASE WHEN dropped IS NOT NULL THEN 0 ELSE 4 + CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 2 ELSE 0 END END AS INTEGER) AS nodes,
  CAST(CASE WHEN dropped IS NOT NULL THEN 0 ELSE 3 + CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 2 ELSE 0 END END AS INTEGER) AS edges FROM r""")
def conclusion_inferences(t):
    """An inference for each customer over the orders as records: every stage fails for some, some graphs need mending."""
    ends = t("customer").select(Q("c_custkey").cast("string").alias("inference_id"), F.lit("s").alias("statement"), F.concat(F.lit("so it ends with number "), "c_custkey").alias("conclusion"))
    idx = F.row_number().over(team_window().partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    records = t("orders").select(Q("o_custkey").cast("string").alias("inference_id"), idx.alias("idx"), F.concat(F.lit("t"), idx).alias("title"), F.concat(F.lit("http://u"), idx).alias("url"), Q("o_orderpriority").alias("content"))
    clients = {
        "validate_inference": scripted(1, lambda p: {"indices": [0, 99]}), "infer": scripted(2, lambda p: {"inferences": [f"because {p['inference_id']}"]}),
        "filter_inference": lambda prompts: ["[]" if int(json.loads(p)["inference_id"]) % 9 == 3 else "[1]" for p in prompts],
        "structure_inference": scripted(4, structured), "supplement": lambda prompts: [json.dumps(joined_islands(json.loads(p))) for p in prompts],
    }
    found = report_flows.inferences(ends, records, clients)
    return found.select("inference_id", "dropped", "inference", F.size("nodes").alias("nodes"), F.size("edges").alias("edges"))


PROMPT = """Order {{ o_orderkey }}{% if urgent %} (urgent){% endif %}:
{% if items %}
  {% for i in items %}
{{ loop.index }}. part {{ i.part }}{% if i.quantity > 40 %}, many{% elif i.quantity < 5 %}, few{% endif %}

  {% endfor %}
{% else %}
nothing
{% endif %}
{{ items | length }} in all"""


@query("""
WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS n, l_partkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS k, string_agg(n || '. part ' || l_partkey || CASE WHEN q > 40 THEN ', many' WHEN q < 5 THEN ', few' ELSE '' END || chr(10), '' ORDER BY n) AS s FROM i GROUP BY 1)
SELECT o_orderkey, 'Order ' || o_orderkey || CASE WHEN o_orderpriority LIKE '1%' THEN ' (urgent)' ELSE '' END || ':' || chr(10) || coalesce(s, 'nothing' || chr(10)) || coalesce(k, 0) || ' in all' AS prompt
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def order_prompts(t):
    """A prompt for each order by a template with a loop inside a condition and conditions inside the loop."""
    item = F.struct(Q("l_partkey").alias("part"), Q("l_quantity").cast("int").alias("quantity"))
    items = t("lineitem").groupBy("l_orderkey").agg(ordered_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"), item).alias("items"))
    rows = t("orders").join(items, Q("l_orderkey") == Q("o_orderkey"), "left").select("o_orderkey", Q("o_orderpriority").startswith("1").alias("urgent"), "items")
    return rows.select("o_orderkey", templates.rendered(rows, PROMPT).alias("prompt"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN '{"key": ' || o_orderkey || ', "status": "' || o_orderstatus || '", "items": [1, null]}' WHEN 4 THEN '{"key": ' || o_orderkey || '}'
  ELSE '{"key": ' || o_orderkey || ', "status": "' || o_orderstatus || '", "items": [1, 2], "note": "' || o_orderpriority || '"}' END AS reply FROM orders""")
def mended_replies(t):
    """Replies that are almost JSON, each of five kinds of damage, as JSON."""
    key, status, note = Q("o_orderkey"), Q("o_orderstatus"), Q("o_orderpriority")
    kinds = [
        F.format_string('```json\n{"key": %d, "status": "%s", "items": [1, 2,], "note": "%s",}\n```', key, status, note), F.format_string("Here: {key: %d, 'status': '%s', items: [1 2], // two\n note = \"%s\"}", key, status, note),
        F.format_string('{"key" %d "status": "%s" "items": [1, 2], "note": "%s', key, status, note),
        F.format_string('{"key": %d, "status": "%s", "items": [1, None', key, status), F.format_string('{"key": %d, ', key),
    ]
    text = kinds[0]
    for k in range(1, 5):
        text = F.when(key % 5 == k, kinds[k]).otherwise(text)
    return t("orders").select("o_orderkey", replies.json_text(text).alias("reply"))


KINDS = {"view": "start", "click": "wait", "signup": "resume", "purchase": "cancel", "error": "done"}


def lifecycle_events(t):
    """Events as those of 29 sessions of each user."""
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return t("events").select(Q("user_id").alias("space"), (Q("event_id") % 29).alias("session"), kinds[Q("event_type")].alias("kind"), "event_id", "ts")


DEADLINE_MS = 150 * 3_600_000
LIFE = "STRUCT(s BIGINT, st VARCHAR, t BIGINT, e BIGINT, since BIGINT)"


@query(f"""
WITH RECURSIVE e AS (
  SELECT user_id AS space, event_id % 29 AS s, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'wait' WHEN 'signup' THEN 'resume' WHEN 'purchase' THEN 'cancel' WHEN 'error' THEN 'done' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
w AS (
  SELECT DISTINCT space, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS act, CAST([] AS {LIFE}[]) AS live, CAST([] AS {LIFE}[]) AS expired, CAST(NULL AS BIGINT) AS evicted FROM e
  UNION ALL
  SELECT space, n, s, ms, event_id, act, CASE WHEN len(l2) > 10 THEN l2[2:] ELSE l2 END, expired, CASE WHEN len(l2) > 10 THEN l2[1].s END FROM (
    SELECT *, CASE WHEN act = 'started' THEN list_append(l1, CAST({{'s': s, 'st': 'running', 't': ms, 'e': event_id, 'since': NULL}} AS {LIFE}))
      WHEN act = 'waiting' THEN list_transform(l1, lambda x: CASE WHEN x.s = s THEN CAST({{'s': s, 'st': 'waiting', 't': x.t, 'e': x.e, 'since': ms}} AS {LIFE}) ELSE x END)
      WHEN act = 'resumed' THEN list_transform(l1, lambda x: CASE WHEN x.s = s THEN CAST({{'s': s, 'st': 'running', 't': x.t, 'e': x.e, 'since': NULL}} AS {LIFE}) ELSE x END)
      WHEN act IN ('cancelled', 'done') THEN list_filter(l1, lambda x: x.s <> s) ELSE l1 END AS l2 FROM (
      SELECT *, CASE WHEN kind = 'start' AND st IS NULL THEN 'started' WHEN kind = 'wait' AND st = 'running' THEN 'waiting' WHEN kind = 'resume' AND st = 'waiting' THEN 'resumed' WHEN kind = 'cancel' AND st IS NOT NULL THEN 'cancelled'
        WHEN kind = 'done' AND st = 'running' THEN 'done' ELSE 'ignored' END AS act FROM (
        SELECT *, list_filter(l1, lambda x: x.s = s)[1].st AS st FROM (
          SELECT e.space, e.n, e.s, e.ms, e.event_id, e.kind, list_filter(w.live, lambda x: x.st = 'waiting' AND x.since + {DEADLINE_MS} <= e.ms) AS expired,
            list_filter(w.live, lambda x: NOT coalesce(x.st = 'waiting' AND x.since + {DEADLINE_MS} <= e.ms, false)) AS l1
          FROM w JOIN e ON e.space = w.space AND e.n = w.n + 1) AS a) AS b) AS c) AS d),
z AS (SELECT space, arg_max(live, n) AS live FROM w GROUP BY space), m AS (SELECT max(ms) AS until FROM e)
SELECT space, s AS session, ms, event_id, act AS outcome FROM w WHERE n > 0
UNION ALL SELECT space, evicted, ms, event_id, 'evicted' FROM w WHERE evicted IS NOT NULL
UNION ALL SELECT space, x.s, x.since + {DEADLINE_MS}, NULL, 'expired' FROM (SELECT space, unnest(expired) AS x FROM w) AS u
UNION ALL SELECT space, x.s, x.since + {DEADLINE_MS}, NULL, 'expired' FROM (SELECT space, unnest(live) AS x FROM z) AS u, m WHERE x.st = 'waiting' AND x.since + {DEADLINE_MS} <= until""")
def session_lives(t):
    """What becomes of each session event; sessions that wait for more than 150 hours expire, an eleventh evicts the oldest."""
    events = lifecycle_events(t)
    return lifecycles.lives(events, DEADLINE_MS, lifecycles.session_events(events).agg(F.max("ms").alias("ms")))
