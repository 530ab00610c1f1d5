"""Mixing domains to target weights: soft domain memberships and fitted document rates, in DataFrame operations only.

A classifier, itself a table of word-bucket weights learned from labelled rows,
gives every document a posterior over the domains. Document rates are fitted by
projected gradient steps on the least squares distance between the domains'
expected tokens and their targets; a step needs one aggregate, of one number a
domain, over all documents.
"""

import math

import numpy as np
from pyspark.sql import functions as F

from .shared import literal_rows, stored

#: Words are hashed to this many rows of the classifier's table; no word is left out.
BUCKETS = 4096
#: Words whose evidence counts in full; that of longer texts is scaled down to as many, so that memberships stay soft.
EVIDENCE = 3
STEPS = 40
CLOSE = 1e-4


def _words(docs):
    """Every row with the bucket of each of its words; rows without words once, with a null bucket."""
    plain = F.translate(F.lower(F.coalesce("text", F.lit(""))), "\n\r\t", "   ")
    filled = F.filter(F.split(plain, " "), lambda w: w != "")
    return docs.select(*[c for c in docs.columns if c != "text"], F.explode_outer(filled).alias("word")).withColumn(
        "bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).withColumn("bucket", F.when(F.col("word").isNotNull(), F.col("bucket")))


def classifier(labelled, most_rows=20_000, most_domains=64):
    """(domains, priors, {bucket: log-probabilities}) of naive Bayes over ``labelled`` (doc_id, text, domain).

    Priors count every labelled row. The word table comes from a bounded sample:
    about ``most_rows`` rows by a hash of doc_id and text. Null domains teach
    nothing; more than ``most_domains`` domains are an error.
    """
    labelled = labelled.select("doc_id", "text", F.col("domain").cast("string").alias("domain")).where(F.col("domain").isNotNull())
    sizes = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").limit(most_domains + 1).collect()}
    if len(sizes) > most_domains:
        raise ValueError(f"more than {most_domains} domains")
    domains, total = sorted(sizes), sum(sizes.values())
    share = most_rows / max(1, total)
    chosen = labelled if share >= 1 else labelled.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)) < share * (1 << 30))
    counts = np.ones((len(domains), BUCKETS)) * 0.5
    # One row per domain and bucket.
    for r in _words(chosen.select("domain", "text")).where(F.col("bucket").isNotNull()).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[domains.index(r["domain"]), r["bucket"]] += r["n"]
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return domains, [math.log(sizes[d] / total) for d in domains], logs


def posteriors(docs, model, evidence=EVIDENCE):
    """(doc_id, text_hash, n_tokens, p0, p1, ...) of every row of ``docs``; a text without words gets the priors."""
    domains, priors, logs = model
    spark = docs.sparkSession
    rows = _words(docs.select(F.col("doc_id").cast("long"), "text").select(
        "doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row")))
    fields = "bucket int, " + ", ".join(f"w{k} double" for k in range(len(domains)))
    table = literal_rows(spark, [(b, *(float(x) for x in logs[:, b])) for b in range(BUCKETS)], fields)
    told = rows.join(F.broadcast(table), "bucket", "left").groupBy("row").agg(  # BUCKETS rows
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.count("word").alias("n_tokens"),
        *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(domains))])
    scale = F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest(F.col("n_tokens"), F.lit(1)))
    logits = [F.col(f"s{k}") * scale + F.lit(priors[k]) for k in range(len(domains))]
    told = told.select("doc_id", "text_hash", "n_tokens", *[x.alias(f"l{k}") for k, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"l{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("l0")
    told = told.select("doc_id", "text_hash", "n_tokens", *[F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in range(len(domains))])
    whole = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
    return told.select("doc_id", "text_hash", "n_tokens", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(len(domains))])


def _dot(step):
    return sum((F.col(f"p{k}") * F.lit(float(x)) for k, x in enumerate(step)), F.lit(0.0))


def fitted(members, weights, budget=None, keep_all=False, steps=STEPS, close=CLOSE):
    """``members`` (n_tokens, p0, ...) with the column rate, and what the fit reached.

    Rates start at 1 and stay at 0 or more. Targets are ``weights`` (in the
    domains' order) of ``budget`` tokens, by default as many as there are. With
    ``keep_all`` rates stay at 1 or more, so that no row is lost, and without a
    budget it grows with every step to the one nearest to the totals: as many
    tokens as it takes. Domains of weight 0 then have no target but keep what
    they have. Steps are gradient steps in the metric of the domains' token
    products; one that brings the totals no nearer is taken back and replaced by
    a plain gradient step.
    """
    n = len(weights)
    sums = [F.sum(F.col("n_tokens") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    first = members.agg(*[F.sum(F.col("n_tokens") * F.col(f"p{k}")).alias(f"t{k}") for k in range(n)], *sums).head()
    now = np.array([first[f"t{k}"] or 0.0 for k in range(n)])
    gram = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    weights = np.array(weights, float) / sum(weights)
    if not now.sum():
        return members.withColumn("rate", F.lit(1.0)), {"targets": now, "reached": now, "steps": 0}
    if budget is None and not keep_all:
        budget = now.sum()
    lowest, free = (1.0, weights == 0) if keep_all else (0.0, np.zeros(n, bool))

    def aims(totals):
        own = weights @ totals / (weights @ weights) if budget is None else budget
        return np.where(free, totals, weights * own)

    targets = aims(now)
    inverse, plain = np.linalg.pinv(gram, rcond=1e-9), 1 / np.linalg.eigvalsh(gram)[-1]
    rates = members.withColumn("rate", F.lit(1.0))
    taken, safe = 0, False
    while taken < steps and np.abs(now - targets).max() > close * targets.sum():
        step = (now - targets) * plain if safe else inverse @ (now - targets)
        tried = rates.withColumn("rate", F.greatest(F.lit(lowest), F.col("rate") - _dot(step)))
        row = tried.agg(*[F.sum(F.col("n_tokens") * F.col(f"p{k}") * F.col("rate")).alias(f"t{k}") for k in range(n)]).head()
        reached = np.array([row[f"t{k}"] for k in range(n)])
        taken += 1
        if not safe and np.linalg.norm(reached - aims(reached)) >= 0.98 * np.linalg.norm(now - targets):
            safe = True
            continue
        rates, now, targets, safe = tried, reached, aims(reached), False
        if taken % 8 == 0:  # keeps the plan short
            rates = stored(rates, "mixing-rates")
    return rates, {"targets": targets, "reached": now, "steps": taken}


def mixed(docs, labelled, targets, budget=None, keep_all=False, most_rows=20_000):
    """doc_id, text_hash, n_tokens, domain (likeliest), posterior (in the order of the domains' names), rate and copies of every row of ``docs``.

    ``labelled``: (doc_id, text, domain). ``targets``: {domain: weight};
    a domain not named has the weight 0, a named one without labelled rows is
    an error. With ``keep_all`` every row has one copy at least. ``copies``: the rate rounded down or up by a hash of doc_id and
    text, so that copies average the rate. Null texts have no tokens and the
    domains' priors; rows that repeat have equal rates. Columns beyond doc_id and
    text are not read. An empty table gives no rows; no labels are an error.
    """
    model = classifier(labelled, most_rows)
    domains = model[0]
    if set(targets) - set(domains) or not domains:
        raise ValueError(f"no labelled rows of {sorted(set(targets) - set(domains)) or 'any domain'}")
    members = stored(posteriors(docs, model), "mixing-members")
    rates, _ = fitted(members, [targets.get(d, 0.0) for d in domains], budget, keep_all)
    best = F.array(*[F.col(f"p{k}") for k in range(len(domains))])
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.coalesce("text_hash", F.lit(0)), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    return rates.select(
        "doc_id", "text_hash", "n_tokens", F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position(best, F.array_max(best)).cast("int")).alias("domain"),
        best.alias("posterior"), "rate", (whole + (draw < F.col("rate") - whole).cast("int")).cast("int").alias("copies"))


def applied(docs, plan):
    """``docs`` with every row as often as ``plan`` (of ``mixed``) says; its columns stay as they are."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__null")]
    wanted = plan.where(F.col("copies") > 0).groupBy(*key, F.coalesce("text_hash", F.lit(0)).alias("__hash")).agg(F.max("copies").alias("__copies"))
    keyed = docs.select("*", *key, F.coalesce(F.xxhash64("text"), F.lit(0)).alias("__hash"))
    found = keyed.join(wanted.hint("shuffle_hash"), ["__id", "__null", "__hash"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
