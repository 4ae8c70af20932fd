"""Scores as columns: BM25 without corpus statistics, coverage, proximity, cosine, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, AVERAGE_WORDS, ALL_MATCHED = 1.5, 0.75, 120.0, 3.5
WINDOW_WORDS = 15


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is named through a lambda, so that it is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def bm25(tokens: Column, words: Column) -> Column:
    """Saturated term counts of ``tokens`` (repeats count) in ``words``, and a bonus if all stand there."""
    count = lambda t: F.when(F.length(t) < 2, 0).otherwise(F.size(F.filter(words, lambda w: w == t)))
    return bm25_of(F.transform(tokens, count), F.size(words))


def bm25_of(counts: Column, n_words: Column) -> Column:
    """The same of counts, one for each token, in a text of ``n_words``."""
    norm = K1 * ((1 - B) + B * n_words / AVERAGE_WORDS)

    def scored(counts: Column) -> Column:
        every = (F.size(counts) > 0) & F.forall(counts, lambda n: n > 0)
        return total(F.transform(counts, lambda n: n * (K1 + 1) / (n + norm))) + F.when(every, ALL_MATCHED).otherwise(0.0)

    return _once(counts, scored)


def token_weights(tokens: Column) -> Column:
    """array<struct<token, weight, role>>: by length, being the last of several, and holding a digit."""

    def one(t: Column, i: Column) -> Column:
        n = F.length(t)
        last = (F.size(tokens) >= 2) & (i == F.size(tokens) - 1)
        digit = t.rlike(r"\p{Nd}")
        weight = F.when(n <= 2, 0.8).when(n >= 4, 1.4).otherwise(1.0) + F.when(last, 1.2).otherwise(0.0) + F.when(digit, 2.0).otherwise(0.0)
        role = F.when(digit, "IDENTIFIER").when(last, "DISCRIMINATOR").when(n <= 2, "SHORT").when(n >= 4, "SPECIFIC").otherwise("NORMAL")
        return F.struct(t.alias("token"), weight.alias("weight"), role.alias("role"))

    return F.transform(tokens, one)


def coverage(weights: Column, words: Column) -> Column:
    """Weight of the tokens that stand among ``words``, of all weight."""
    whole = total(F.transform(weights, lambda w: w["weight"]))
    hit = total(F.transform(weights, lambda w: F.when(F.array_contains(words, w["token"]), w["weight"]).otherwise(0.0)))
    return F.when(whole > 0, hit / whole).otherwise(0.0)


def acronym_at(words: Column, token: Column) -> Column:
    """The first letters of some consecutive words spell ``token``."""
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return (F.length(token) >= 2) & initials.contains(token)


def prefix_weight(token: Column, expansion: Column) -> Column:
    more = F.length(expansion) - F.length(token)
    return (
        F.when(~expansion.startswith(token), 0.0).when(more == 0, 1.0).when(more <= 2, 0.95).when(more <= 4, 0.75).when(more <= 6, 0.55).otherwise(0.35)
    )


def first_prefix_position(words: Column, token: Column) -> Column:
    """Place (from 0) of the first word that starts with ``token``; -1 if none."""
    return (F.array_position(F.transform(words, lambda w: w.startswith(token)), True) - 1).cast("int")


def proximity(tokens: Column, words: Column) -> Column:
    """4, 2, 1 or 0 by the least distance of the first places of two different tokens."""
    places = F.transform(F.array_distinct(tokens), lambda t: first_prefix_position(words, t))
    return proximity_of(tokens, F.filter(places, lambda p: p >= 0))


def proximity_of(tokens: Column, places: Column) -> Column:
    """The same of the first places of the different tokens that have one."""

    def graded(ordered: Column) -> Column:
        # the least distance of any two is that of neighbours in order
        gaps = F.zip_with(F.slice(ordered, 2, 1 << 20), F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda b, a: b - a)
        return _once(F.array_min(gaps), lambda least: F.when(least <= 3, 4.0).when(least <= 10, 2.0).when(least <= 25, 1.0).otherwise(0.0))

    return F.when(F.size(tokens) < 2, 0.0).otherwise(_once(F.sort_array(places), graded))


def in_window(tokens: Column, words: Column, width: int = WINDOW_WORDS) -> Column:
    """All tokens start a word within some ``width`` consecutive words."""
    hits = F.transform(tokens, lambda t: F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).startswith(t)))
    return in_window_of(tokens, hits, width)


def in_window_of(tokens: Column, hits: Column, width: int = WINDOW_WORDS) -> Column:
    """The same of the places at which each token starts a word."""

    def near(hits: Column) -> Column:
        return F.exists(F.array_distinct(F.flatten(hits)), lambda s: F.forall(hits, lambda h: F.exists(h, lambda p: (p >= s) & (p < s + width))))

    return (F.size(tokens) < 2) | _once(hits, near)


def metadata_boost(name: Column, path: Column) -> Column:
    name, path = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(name.rlike(r"\.(pdf|doc|docx)$"), 0.20).otherwise(0.0)
        + F.when(name.rlike(r"\.(jpg|jpeg|png|webp)$"), 0.25).otherwise(0.0)
        + F.when(path.contains("download") | path.contains("document"), 0.15).otherwise(0.0)
    )


def chunk_score(lexical: Column, semantic: Column, boost: Column, meta: Column, near: Column, cover: Column, canonical_only: Column) -> Column:
    base = lexical * 2.80 + semantic * 0.55 + boost + meta + near + cover * 2.50
    base = F.when((cover < 1.0) & ~canonical_only, base * 0.55).otherwise(base)
    return base + F.when(lexical > 2.0, 1.20).otherwise(0.0)


# ------------------------------------------------------------------ vectors


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """0 for null, unequal or zero vectors; give norms that are known."""
    length = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length).otherwise(0.0)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


# ------------------------------------------------------------------ reranking


def rerank(query: Column, text: Column, semantic: Column, lexical: Column) -> Column:
    """Blend of scores, share of query words in the text, whole phrase, all words, and distances."""
    query, text = F.trim(F.lower(query)), F.lower(text)
    tokens = F.split(query, r"\s+")
    held = F.size(F.filter(tokens, lambda t: (F.length(t) >= 2) & text.contains(t)))
    near = F.flatten(
        F.transform(tokens, lambda a, i: F.transform(F.slice(tokens, i + 2, F.size(tokens)), lambda b: F.struct(_at(text, a).alias("p"), _at(text, b).alias("q"))))
    )
    gap = lambda x: F.abs(x["p"] - x["q"])
    bonus = total(
        F.transform(near, lambda x: F.when((x["p"] == 0) | (x["q"] == 0), 0.0).when(gap(x) < 30, 4.0).when(gap(x) < 80, 2.0).when(gap(x) < 150, 1.0).otherwise(0.0))
    )
    return (
        semantic * 0.45 + lexical * 0.55 + held / F.size(tokens) * 1.20
        + F.when(text.contains(query), 2.50).otherwise(0.0)
        + F.when((F.size(tokens) >= 2) & (held == F.size(tokens)), 4.00).otherwise(0.0)
        + bonus * 0.85
    )


def _at(text: Column, token: Column) -> Column:
    return F.call_function("instr", text, token)


# ------------------------------------------------------------------ confidence; NULL is unavailable


def saturating(x: Column, half: float) -> Column:
    return F.when(x >= 0, x / (x + half))


def bounded(x: Column) -> Column:
    return F.when((x >= 0) & (x <= 1), x)


def margin_signal(candidates: Column, own: Column, second: Column, margin: Column) -> Column:
    """Of the best document its relative lead, of others 0; unavailable for fewer than two candidates."""
    best = second + margin
    tolerance = F.greatest(F.lit(1e-6), best * 1e-6)
    ok = (candidates >= 2) & (own > 0) & (second >= 0) & (margin >= 0) & (best > 0)
    return F.when(ok, F.when(own < best - tolerance, 0.0).otherwise(saturating(margin / best, 0.15)))


def confidence(bm25_: Column, semantic: Column, cover: Column, canonical: Column, margin: Column, agreed: Column) -> Column:
    """The strongest layer, a little of the second and of agreement, scaled by the margin."""
    lexical, semantic, canonical = F.sqrt(bm25_ * cover), semantic * 0.85, canonical * 0.80
    layers = F.sort_array(F.filter(F.array(lexical, semantic, canonical), lambda x: x.isNotNull()), asc=False)
    strongest, second = F.get(layers, 0), F.get(layers, 1)
    c = strongest + F.when(second.isNotNull(), (1 - strongest) * 0.20 * second).otherwise(0.0)
    c = c + F.when(agreed, (1 - c) * 0.05).otherwise(0.0)
    return c * F.when(margin.isNotNull(), 0.85 + 0.15 * margin).otherwise(1.0)


def agreement(support: Column, components: Column, strength: Column) -> Column:
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength / support))
    return F.when((support > 0) & (components > 0), (support + mean) / (components + 1)).otherwise(0.0)
