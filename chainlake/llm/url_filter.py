"""URL filter: listed rules first, link-graph propagation for all other hosts.

Hosts are linked by the absolute links of their pages.  Trust is personalised
PageRank from hosts with allowed pages along links; distrust is the same
recursion from hosts with blocked pages against the links, so that it reaches
those that point at bad hosts.  A seed's weight is the share of its pages that
a rule allows or blocks.  A host is blocked if its distrust outweighs its
trust and a neutral prior; both scores count in units of a seed, so the
threshold means the same at every size of the web.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut_lineage

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-4     # of a score or of the neutral mass, whichever is more; less movement ends the propagation
MAX_ROUNDS = 400     # guards against a fault: passing it raises
CHECK_EVERY = 4      # rounds between cutting the lineage and looking for convergence
PRIOR = 0.5          # neutral mass, in seeds
BLOCK_FROM = 0.5     # share of distrust from which a host is blocked
HOT = 10_000         # pages or links of a host from which its rows are spread over SALTS tasks
SALTS = 16
# Comments and scripts are matched too, so that links in them are passed over; no alternative looks beyond
# its own tag, comment or script, and one that never ends takes the rest of the text, so a text is read once.
LINK = (r"""(?is)<!--.*?(?:-->|\z)|<(script|style|textarea)\b.*?(?:</\1|\z)|"""
        r"""<a\s[^<>]*?\bhref\s*=\s*(?:["']\s*)?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)""")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null fields if none does.

    A rule is a host, with all its subdomains, and a path prefix.  The list is
    the caller's own and is put into the plan as one literal.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r))
    known = F.array(*[F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"),
                               F.lit(text.partition("/")[0]).alias("host"),
                               F.lit("/" + text.partition("/")[2]).alias("path")) for verdict, text in ordered])
    if not ordered:
        return F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
                    & F.startswith(path, r["path"]))
    best = F.try_element_at(fits, F.lit(1))
    return F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) of links between different hosts; pages has host and html."""
    to = F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("html", F.lit(LINK), F.lit(2)), lambda h: ascii_lower(h))))
    return (pages.where(F.col("html").isNotNull() & (F.col("host") != ""))
            .select(F.col("host").alias("src"), to.alias("dst"))
            .where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, score) after convergence; edges (kind, src, dst, n), seeds (kind, host, seed).

    Scores obey score = (1 - DAMPING) * seed + DAMPING * sum of what the
    linking hosts pass on, in units of seeds: PageRank that returns dangling
    mass to the seeds, up to its constant factor.
    """
    total = cut_lineage(edges.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("links")))
    hubs = F.broadcast(total.where(F.col("links") >= HOT).select("kind", "src", F.lit(SALTS).alias("ways")))  # |edges| / HOT at most
    flow = cut_lineage(edges.join(total, ["kind", "src"]).select(
        "kind", "src", "dst", (F.col("n") / F.col("total")).alias("share"),
        F.when(F.col("links") >= HOT, F.pmod(F.xxhash64("dst"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")))
    base = cut_lineage(seeds.select("kind", "host", ((1 - DAMPING) * F.col("seed")).alias("score")))
    if flow.isEmpty():
        return base
    state = base
    least = (1 - DAMPING) * PRIOR
    for _ in range(0, MAX_ROUNDS, CHECK_EVERY):
        before = state
        for _ in range(CHECK_EVERY):
            passed = (flow.join(_spread(state.withColumnRenamed("host", "src"), hubs, ["kind", "src"]), ["kind", "src", "salt"])
                      .select("kind", F.col("dst").alias("host"), (DAMPING * F.col("score") * F.col("share")).alias("score")))
            state = passed.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        state = cut_lineage(state)
        both = state.withColumn("was", F.lit(0.0)).unionByName(
            before.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("was")))
        moved = (both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("was").alias("was"))
                 .agg(F.max(F.abs(F.col("score") - F.col("was")) / F.greatest("score", F.lit(least)))).first()[0])
        if (moved or 0.0) <= TOLERANCE:
            return state
    raise RuntimeError(f"scores still move after {MAX_ROUNDS} rounds")


def _spread(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with a salt: one copy for each of the ``ways`` of a hot key, salt 0 for all others."""
    last = F.coalesce("ways", F.lit(1)) - 1
    return rows.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("ways")


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id",
                url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path; such pages
    and those of hosts that no score reaches are allowed unless a rule says
    otherwise.  A null html has no links; null ids and repeated rows are kept;
    an empty table gives an empty result; other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    judged = urls.withColumn("m", match_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", "m.rule", F.col("m.verdict").alias("listed"))
    share = [F.avg((F.coalesce("listed", F.lit("")) == v).cast("double")).alias(v) for v in ("allow", "block")]
    hosts = cut_lineage(judged.where("host <> ''").groupBy("host").agg(*share, F.count(F.lit(1)).alias("pages")))
    seeds = cut_lineage(hosts.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("seed")))).alias("s")).select("s.kind", "host", "s.seed"))
    links = cut_lineage(host_edges(urls))
    edges = (links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
             .unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"),
                                       F.col("src").alias("dst"), "n")))
    scores = (propagate(edges, seeds).groupBy("host")
              .agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"),
                   F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust")))
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    bad = distrust / (distrust + trust + F.lit((1 - DAMPING) * PRIOR)) >= BLOCK_FROM
    hot = F.broadcast(hosts.where(F.col("pages") >= HOT).select("host", F.lit(SALTS).alias("ways")))  # |pages| / HOT at most
    dealt = (judged.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.coalesce("ways", F.lit(1)))
                                                         .cast("int")).drop("ways"))
    return dealt.join(_spread(scores, hot, ["host"]), ["host", "salt"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))
