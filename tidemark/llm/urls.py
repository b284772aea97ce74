"""URL verdicts: host and path rules first, else a tree of path templates per host with labelled purity.

The tree is grown level by level over all pages of a host. At a node, a segment with fewer than
SUPPORT labelled pages beneath it is variable and becomes `*`, together with all of its kind. Every other
branch, however many there are, is compared with its node by the labels beneath both: a branch whose
share of bad pages lies within two standard deviations of the node's is merged with its like into `~`; another
keeps its own name. So a branch's name depends on its own labels and the node's, not on how many
neighbours it has. The template of a page is the path so written; the last level takes the rest of a longer
path as one segment.

A template is rejected when its share of bad labelled pages, smoothed with STRENGTH pages of the
overall share, exceeds a half.

All of it is aggregation and equi-joins on (host, template); counts are combined before they are
shuffled, so that a host with a third of all pages is no single task. Between levels the rows are
written to the shared folder.

Edge cases: a null url or one without `://` has empty host and path, and a template like any
other; pages without label count in no share; a page labelled more than once has its best label;
without any label nothing is rejected. Repeated rows and null ids stay rows of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

# Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LEVELS = 4
SUPPORT = 5
STRENGTH = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"


def host(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits `host` and `path`; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):
        fits = ((F.col("host") == domain) | F.col("host").endswith(f".{domain}")) & F.col("path").startswith(prefix)
        name, verdict = F.when(fits, domain + prefix).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def similar(bad: str, labelled: str, all_bad: str, all_labelled: str) -> str:
    """Whether a branch's bad pages are within two standard deviations of its node's share, in whole numbers."""
    return f"({bad} * {all_labelled} - {labelled} * {all_bad}) * ({bad} * {all_labelled} - {labelled} * {all_bad}) <= 4 * {labelled} * {all_bad} * ({all_labelled} - {all_bad})"


def similar_at_any_size(bad: str, labelled: str, all_bad: str, all_labelled: str) -> str:
    """`similar` for Spark, whose whole numbers overflow: decimals while the square has 36 digits, doubles beyond."""
    wide = [f"cast({x} as decimal(19, 0))" for x in (bad, labelled, all_bad, all_labelled)]
    real = [f"cast({x} as double)" for x in (bad, labelled, all_bad, all_labelled)]
    gap = f"cast({wide[0]} * {wide[3]} - {wide[1]} * {wide[2]} as decimal(19, 0))"
    exact = f"{gap} * {gap} <= cast(4 * {labelled} as decimal(19, 0)) * cast({wide[2]} * ({wide[3]} - {wide[2]}) as decimal(19, 0))"
    return f"if({real[1]} * {real[3]} < 1e18, {exact}, {similar(*real)})"


def grown(rows: DataFrame) -> DataFrame:
    """Adds `template` to rows of (page_id, host, path, labelled, bad)."""
    rows = rows.selectExpr("*", "split(substring(path, 2), '/') as segments", "'' as template")
    for level in range(LEVELS):
        last = level == LEVELS - 1
        segment = f"array_join(slice(segments, {LEVELS}, greatest(size(segments) - {level}, 1)), '/')" if last else f"segments[{level}]"
        rows = rows.selectExpr("*", f"if(size(segments) > {level}, {segment}, null) as segment")
        children = rows.filter("segment is not null").groupBy("host", "template", "segment").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        nodes = children.groupBy("host", "template").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        steps = children.filter(F.col("l") >= SUPPORT).join(nodes, ["host", "template"]).selectExpr("host", "template", "segment", f"if({similar_at_any_size('b', 'l', 'all_b', 'all_l')}, '~', segment) as step")
        rows = rows.join(steps, ["host", "template", "segment"], "left").selectExpr(
            "page_id", "host", "path", "labelled", "bad", "segments", "if(segment is null, template, concat(template, '/', coalesce(step, '*'))) as template"
        )
        if not last:
            rows = written(rows, "urls")
    return rows.drop("segments")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, and the labelled and bad pages of the template.

    `labels` has doc_id, the page's id, and quality, 0 for a bad page.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = pages.select("page_id", host().alias("host"), path().alias("path"))
    rows = rows.join(known, rows["page_id"] == known["doc_id"], "left")
    rows = rows.selectExpr("page_id", "host", "path", "cast(quality is not null as bigint) as labelled", "cast(coalesce(quality = 0, false) as bigint) as bad")
    rows = written(grown(written(rows, "urls")), "urls")
    by_template = rows.groupBy("host", "template").agg(F.sum("labelled").alias("n_labelled"), F.sum("bad").alias("n_bad"))
    overall = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l")).first()
    # (bad + STRENGTH * share) / (labelled + STRENGTH) > 1/2, in whole numbers
    total = max(overall["l"], 1)
    rejected = 2 * (F.col("n_bad") * total + STRENGTH * overall["b"]) > (F.col("n_labelled") + STRENGTH) * total
    name, verdict = rule_of(rules)
    return rows.join(by_template, ["host", "template"]).select(
        "page_id",
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        "template",
        "n_labelled",
        "n_bad",
    )


def oracle_sql(rules=RULES) -> str:
    """The same in SQL."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    fits = lambda d, p: f"((host = {quote(d)} or ends_with(host, {quote('.' + d)})) and starts_with(path, {quote(p)}))"
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0]))
    name = "case " + " ".join(f"when {fits(d, p)} then {quote(d + p)}" for d, p, _ in longest) + " end"
    said = "case " + " ".join(f"when {fits(d, p)} then {quote(v)}" for d, p, v in longest) + " end"
    levels = ""
    for k in range(LEVELS):
        segment = f"array_to_string(segments[{k + 1}:], '/')" if k == LEVELS - 1 else f"segments[{k + 1}]"
        levels += f"""
, s{k} as (select *, case when len(segments) > {k} then {segment} end as segment from t{k}),
c{k} as (select host, template, segment, sum(labelled) as l, sum(bad) as b from s{k} where segment is not null group by all),
n{k} as (select host, template, sum(l) as all_l, sum(b) as all_b from c{k} group by all),
t{k + 1} as (
  select s.* exclude (template, segment),
    case when s.segment is null then s.template when l < {SUPPORT} then s.template || '/*'
      when {similar("b", "l", "all_b", "all_l")} then s.template || '/~' else s.template || '/' || s.segment end as template
  from s{k} s left join c{k} c on s.host = c.host and s.template = c.template and s.segment = c.segment
  left join n{k} n on s.host = n.host and s.template = n.template
)"""
    return f"""
with known as (select doc_id, max(quality) as quality from labels where quality is not null group by doc_id),
parsed as (
  select page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') as host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') as path
  from pages
),
t0 as (
  select page_id, host, path, (quality is not null)::bigint as labelled, coalesce(quality = 0, false)::bigint as bad,
    string_split(substr(path, 2), '/') as segments, '' as template
  from parsed left join known on page_id = doc_id
){levels},
totals as (select host, template, sum(labelled)::bigint as n_labelled, sum(bad)::bigint as n_bad from t{LEVELS} group by all),
overall as (select coalesce(sum(bad), 0) as b, greatest(coalesce(sum(labelled), 0), 1) as l from t{LEVELS})
select page_id, t.host, path, {name.replace("host", "t.host")} as rule,
  coalesce({said.replace("host", "t.host")}, case when 2 * (n_bad * l + {STRENGTH} * b) > (n_labelled + {STRENGTH}) * l then 'block' else 'allow' end) as verdict,
  t.template, n_labelled, n_bad
from t{LEVELS} t join totals using (host, template), overall
"""
