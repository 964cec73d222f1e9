"""URL filter: allow and block rules, and trust spread over the links between hosts. DataFrame functions only.

Rules decide the pages they fit. Other pages get their host's verdict: pages that rules allow make their hosts trusted seeds, pages that rules block make theirs
blocked seeds. Trust flows along links by personalised PageRank; distrust flows against them, to hosts that link to blocked ones. A host is blocked
if more distrust than trust reaches it. Both are summed until they are settled, over ways of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: host, path, verdict. A rule fits its host and all subdomains, for paths that start with its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Scores are settled when no host's last inflow is more than TOLERANCE of its score: its error is then under TOLERANCE / (1 - DAMPING). Distrust must
#: exceed trust by more than MARGIN of it, which is more than both errors and any rounding, so equal scores never block.
DAMPING, TOLERANCE, MARGIN = 0.85, 5e-8, 1e-6
#: Rounds between two looks at the tolerance; rounds after which it is an error not to have settled; edges of one host that are one task's work.
SAVE_EVERY, MOST_ROUNDS, HUB = 8, 20_000, 1_000_000
_URL = r"://([^/?#]*)([^?#]*)"
_LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the end. Empty if there are none."""
    return _lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): hosts that link to other hosts, and from how many pages. A link without a host stays on its own and is none."""
    host, _ = host_and_path(F.col("url"))
    found = pages.where("html is not null").select(host.alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), _lower))).alias("dst"))
    return found.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from seeds (host, allow, block: numbers of pages) over edges (src, dst, pages): personalised PageRank, settled.

    A score is the sum of what arrives over paths of 0, 1, 2, ... links, damped at each. A round adds the next length; rounds go on until every host's
    last inflow is within TOLERANCE of its score, so also until no further host is reached, however long the way. Distrust takes the edges
    backwards. Edges of a host with more than HUB of them are dealt to buckets by their number. The table is written every SAVE_EVERY rounds.
    """
    both = scratch.save(edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "pages").unionAll(edges.select(F.lit("distrust"), "dst", "src", "pages")), "both-ways")
    m = both.count()
    out = both.groupBy("kind", "from").agg(F.sum("pages").alias("all"), F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / HUB).cast("int")
    flows = scratch.split_join(both, out, ["kind", "from"], "n", m, hot=HUB).select("kind", "from", "to", (DAMPING * F.col("pages") / F.col("all")).alias("share"), F.pmod(F.xxhash64("to"), salts).cast("int").alias("salt"))
    hubs = out.where(F.col("n") > HUB).select("kind", F.col("from").alias("host"), salts.alias("salts")) if m > HUB else None  # fewer than m / HUB
    total = F.lit(float(seeds.agg(F.coalesce(F.sum(F.col("allow") + F.col("block")), F.lit(0))).first()[0] or 1))
    start = seeds.select(F.lit("trust").alias("kind"), "host", (F.lit(1 - DAMPING) * F.col("allow") / total).alias("score")).unionAll(seeds.select(F.lit("distrust"), "host", F.lit(1 - DAMPING) * F.col("block") / total))
    now = scratch.save(start.where("score > 0").withColumn("last", F.col("score")), "spread")
    # a row from each host to itself, without a share, carries its score into the next round: so a round reads the last one once
    hosts = both.select("kind", "from").unionAll(both.select("kind", "to")).unionAll(now.select("kind", "host")).distinct()
    flows = scratch.save(flows.unionByName(hosts.select("kind", "from", F.col("from").alias("to"), F.lit(None).cast("double").alias("share"), F.lit(0).alias("salt"))), "flows")
    done = 0
    while m and not now.where(F.col("last") > TOLERANCE * F.col("score")).isEmpty():
        if done >= MOST_ROUNDS:
            raise RuntimeError(f"trust did not settle in {MOST_ROUNDS} rounds")
        for _ in range(SAVE_EVERY):
            step = now.withColumn("salt", F.lit(0)) if hubs is None else now.join(F.broadcast(hubs), ["kind", "host"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
            moved = step.withColumnRenamed("host", "from").join(flows, ["kind", "from", "salt"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.when(F.col("share").isNull(), F.col("score")).otherwise(0.0)).alias("score"), F.sum(F.coalesce(F.col("last") * F.col("share"), F.lit(0.0))).alias("last"))
            now = moved.select("kind", "host", (F.col("score") + F.col("last")).alias("score"), "last")
        now, done = scratch.save(now, "spread"), done + SAVE_EVERY
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust (of the host).

    rule: the longest fitting rule as host + path, else null; its verdict holds. Else the host is blocked if its distrust exceeds its trust (by more than
    MARGIN of it), and allowed otherwise: also if nothing is known of it, or it is empty (a null url, or one without `://`). A null html has no links. Null and repeated
    page_ids are kept as they are. An empty table gives no rows. Other columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"))
    count = lambda v: F.count_if(F.col("given") == v).alias(v)
    seeds = scratch.save(ruled.where("given is not null and host != ''").groupBy("host").agg(count("allow"), count("block")), "ruled-hosts")
    scores = scratch.save(spread(seeds, scratch.save(links(pages), "links")), "hosts")
    n_scores = scores.count()
    if n_scores <= scratch.HOT:
        known = ruled.join(F.broadcast(scores), "host", "left")
    else:
        of_host = ruled.groupBy("host").agg(F.count("*").alias("n"))
        known = scratch.split_join(ruled, scores.join(of_host, "host"), ["host"], "n", ruled.count(), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("given", F.when(distrust > trust * (1 + MARGIN), "block").otherwise("allow"))
    return known.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
