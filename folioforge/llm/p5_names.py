"""Variant spellings of names: exact candidates by their rarest word, Monge-Elkan verification, star clustering.

Names are reduced to distinct readings first (case, spacing, outer notes and the abbreviations of the fixed
words below), so exact repetitions cost nothing. Two readings are linked only if each word of one of them, the
shorter or the one with an acronym, has a similar word in the other. So each reading asks with one word, the one
whose similar words the fewest readings have, and every reading that has one of those is its candidate: no pair
that verification would link is left out, however frequent its words are.

Similar words are found by keys that they must share: beginnings, and what is left of them after as many
deletions as they may have edits; words from ``LONG`` letters on, which would have too many, are compared with
all words of the lengths in question. A word's readings are met in as many tasks as they are times ``SMALL_BUCKET``.

Verified links form a graph; star clustering makes the reading with the most links (ties: the smaller id)
the centre of a star with its neighbours, then the next among the rest, until none is left.

Null, empty and letterless names are linked to nothing. Repeated entry_ids count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: the collision curve of a banding; the search of ``links`` is exact and needs none
SIMILARITY, RECALL, HASHES = 0.4, 0.95, 160
#: a word's readings are met in one task for so many of them
SMALL_BUCKET = 200
#: a reading whose rarest word is met more often asks with two words
FEW = 30
LONG = 16
LINK_AT = 0.8
#: the weight of two words that are no partners: no sum that holds it counts
NO_PARTNER = -1e6
#: salts of the join that spells out a venue's pairs
SALTS = 8
#: fixed values: the kinds of publication and bodies, with the ways to write them short
KINDS = {
    "annals": ("annals", "annal", "ann", "anna"),
    "letters": ("letters", "letter", "lett", "ltrs", "let"),
    "journal": ("journal", "jour", "jnl", "journ", "j"),
    "transactions": ("transactions", "transaction", "trans", "tran", "t", "tr"),
    "proceedings": ("proceedings", "proc", "proce", "procs"),
    "symposium": ("symposium", "symp", "sym", "sympo"),
    "conference": ("conference", "conf", "confer"),
    "international": ("international", "int", "intl", "inter", "intern", "internat"),
    "society": ("society", "soc", "socie"),
    "institute": ("institute", "inst", "instit"),
}
SMALL_WORDS = frozenset(("of", "on", "in", "the", "for", "and", "a", "an", "to", "at"))
#: what sets one kind of venue apart from another
EXCLUSIVE = ("annals", "letters", "journal", "transactions", "proceedings", "symposium")
_KIND = {short: kind for kind, forms in KINDS.items() for short in forms}


def _kept(f):
    """Words and readings come again and again, so a task keeps what it has worked out, up to a bound."""
    known: dict = {}

    def keep(*args):
        if args not in known:
            if len(known) >= 1 << 19:
                known.clear()
            known[args] = f(*args)
        return known[args]

    return keep


@_kept
def _kind(word: str) -> str | None:
    """The kind that a word names, in full, short, or mistyped."""
    if word in _KIND:
        return _KIND[word]
    if len(word) >= 5:
        for kind in KINDS:
            limit = 2 if kind in ("international", "symposium", "institute") else 1  # processing is no proceedings
            if word[0] == kind[0] and distance(word, kind, limit) <= limit or distance(word, kind, 1) <= 1:
                return kind
    return None


def tune(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(rows, bands): the most rows whose curve 1 - (1 - s^rows)^bands reaches ``recall`` at ``similarity`` with so many hashes."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if rows * bands <= hashes:
            return rows, bands
    return 1, hashes


def read_name(name: str | None) -> tuple[str, list[tuple[str, bool]]]:
    """(acronym, tokens) of a name; a token is (word, whether it is cut short). Kinds come out in full."""
    text = unicodedata.normalize("NFKC", name or "").replace("’", "'")
    text = re.sub(r"(?i)\bint'l\b", "international", text)
    text = re.sub(r"(?i)[\s,]*([(\[](online|print|e-?only)[)\]]|[-–/:]\s*(open access|continued series|a quarterly|new series)|\bvol\.?\s*\d+|\b(19|20)\d\d)\s*$", "", text.strip())
    text = re.sub(r"(?i)^the (.+) one$", r"\1", text)
    mixed = any(c.islower() for c in text)
    acronym, tokens = "", []
    for m in re.finditer(r"([^\W\d_][\w]*)(\.|')?", text):
        word, mark = m[1], m[2]
        if mixed and not acronym and 3 <= len(word) <= 8 and word.isupper():
            acronym = word.lower()
            continue
        low = word.lower()
        if low in SMALL_WORDS:
            continue
        kind = _kind(low) or (len(low) >= (4 if m[2] == "." else 5) and next((k for k in KINDS if k.startswith(low)), None) or None)
        if kind in ("proceedings", "international", "transactions") and len(low) < 7 and tokens:
            # after other words these are short for processing, interactive or translation
            kind = kind if kind == "transactions" and re.match(r"\s+on\b", text[m.end() :]) else None
        tokens.append((kind, False) if kind else (low, mark is not None))
    return acronym, tokens


def reading(name: str | None) -> str:
    """The text by which names are the same without any doubt: tokens in order, a cut word keeps its stop."""
    acronym, tokens = read_name(name)
    return " ".join(([acronym.upper()] if acronym else []) + [w + "." * cut_ for w, cut_ in tokens])


@_kept
def _tokens(text: str) -> tuple[str, list[tuple[str, bool]]]:
    parts = text.split(" ") if text else []
    acronym = parts[0].lower() if parts and parts[0].isupper() and not parts[0].endswith(".") else ""
    return acronym, [(p.rstrip("."), p.endswith(".")) for p in parts[bool(acronym) :]]


def distance(a: str, b: str, limit: int) -> int:
    """Edits with transpositions, or limit + 1 if there are more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, above = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return limit + 1
        before, above = above, row
    return above[-1]


@_kept
def _letters(word: str) -> int:
    """A bit for each letter of the word (letters may share one)."""
    out = 0
    for c in word:
        out |= 1 << ord(c) % 61
    return out


_edits = _kept(distance)


def word_similarity(a: tuple[str, bool], b: tuple[str, bool], least: int = 4) -> float:
    """From 0 to 1. A beginning may hold a slip from ``least`` letters on."""
    (x, cut_x), (y, cut_y) = a, b
    if x == y:
        return 1.0
    short, long_, is_cut = (x, y, cut_x) if len(x) <= len(y) else (y, x, cut_y)
    if len(short) >= (2 if is_cut else 3) and long_.startswith(short):
        return 0.97 if is_cut else 0.9
    if len(short) < 4:
        return 0.0
    limit = max(1, len(long_) // 4)
    mine, other = _letters(short), _letters(long_)
    # an edit changes at most two letters' being there
    if len(long_) - len(short) <= limit and (mine ^ other).bit_count() <= 2 * limit:
        d = _edits(x, y, limit)
        if d <= limit:
            return 1 - d / len(long_)
    if len(short) >= least and (is_cut or len(short) <= len(long_) - 2) and (mine & ~other).bit_count() <= 1 and _edits(short, long_[: len(short)], 1) <= 1:
        return 0.8
    return 0.0


def _matched(weights: list[list[float]]) -> float:
    """The largest sum of weights that gives each row a column of its own (no more rows than columns), by shortest augmenting paths."""
    n, m = len(weights), len(weights[0])
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, came, seen = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            seen[j], at, step, to = True, row_of[j], math.inf, 0
            for k in range(1, m + 1):
                if not seen[k]:
                    left = -weights[at - 1][k - 1] - u[at] - v[k]
                    if left < least[k]:
                        least[k], came[k] = left, j
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(m + 1):
                if seen[k]:
                    u[row_of[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = to
        while j:
            row_of[j] = row_of[came[j]]
            j = came[j]
    return sum(weights[row_of[k] - 1][k - 1] for k in range(1, m + 1) if row_of[k])


def monge_elkan(a: list[tuple[str, bool]], b: list[tuple[str, bool]], least: int = 4) -> float:
    """Mean, over the words of ``a``, of the similarity with a word of ``b``, each with one of its own if ``b`` has as many; 0 if a word has no partner."""
    if not a or not b:
        return 0.0
    total, rows, used = 0.0, [], set()
    for x in a:
        row = [s if s >= 0.6 else NO_PARTNER for s in (word_similarity(x, y, least) for y in b)]
        best = max(row)
        if best < 0:
            return 0.0
        total += best
        rows.append(row)
        used.add(row.index(best))
    if len(used) < len(a) <= len(b):
        total = _matched(rows)
    return max(0.0, total / len(a))


def name_similarity(left: str, right: str) -> float:
    """Symmetric Monge-Elkan similarity of two readings; an acronym stands for the initials of the words it replaces."""
    if left == right:
        return 1.0
    (ac_a, a), (ac_b, b) = _tokens(left), _tokens(right)
    kinds_a, kinds_b = ({w for w, _ in t if w in EXCLUSIVE} for t in (a, b))
    if kinds_a and kinds_b and not kinds_a & kinds_b:
        return 0.0
    body_a, body_b = ([t for t in ts if t[0] not in KINDS] for ts in (a, b))
    if ac_a and ac_b:
        return min(monge_elkan(body_a, body_b), monge_elkan(body_b, body_a)) if ac_a == ac_b else 0.0
    if ac_a or ac_b:
        acronym, place, full = (ac_a, body_a, b) if ac_a else (ac_b, body_b, a)
        rest, used = [], 0.0
        for t in full:
            fit = max((word_similarity(t, p) for p in place), default=0.0) if t[0] not in KINDS else 0.0
            if fit >= 0.7:
                used += fit
            else:
                rest.append(t)
        if not place or used < 0.7 * len(place) or monge_elkan(place, full) == 0:
            return 0.0
        initials = "".join(w[0] for w, _ in rest)
        topic = "".join(w[0] for w, _ in rest if w not in KINDS)
        if initials == acronym or (len(topic) >= 2 and not any(w in KINDS for w, _ in rest) and topic in acronym):
            return 0.9
        # the kinds may be left out of an acronym, or of the name
        return 0.85 if len(topic) >= 2 and (acronym == topic or (acronym.endswith(topic) or acronym.rstrip("is").endswith(topic) and len(topic) >= 3)) and acronym[0] == initials[0] else 0.0
    short, long_ = (body_a, body_b) if len(body_a) <= len(body_b) else (body_b, body_a)
    if len(long_) - len(short) > 1:
        return 0.0
    if len(long_) - len(short) == 1 and len(short) >= 3 and not any(w in KINDS for w, _ in (a if short is body_a else b)):
        # said in passing: no kind, one word left out; four letters with a slip may begin any word, so they don't make up for it
        return min(0.85, monge_elkan(short, long_, 5))
    return min(monge_elkan(body_a, body_b), monge_elkan(body_b, body_a))


def readings(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry_id, reading) of the named entries, and the distinct readings (id, reading, n)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"entry_id": batch["entry_id"], "reading": [reading(x) for x in batch["journal_name"]]})

    entries = cut(
        typed.select("entry_id", "journal_name").where("entry_id is not null").dropDuplicates(["entry_id"])
        .repartition(typed.sparkSession.sparkContext.defaultParallelism * 2).mapInPandas(read, "entry_id long, reading string").where("reading <> ''")
    )
    distinct = cut(entries.groupBy("reading").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("id")))
    return entries, distinct


def word_keys(word: str) -> tuple[set[str], set[str]]:
    """(asked, held): of two similar words of fewer than ``LONG`` letters the longer holds a key that the shorter asks for."""
    asked, held = {"=" + word}, {"=" + word} | {"=" + word[:i] for i in range(2, len(word))}
    if len(word) >= 4:
        asked |= {f"{len(word)}{word[:i] + word[i + 1 :]}" for i in range(len(word))}
        held |= {f"{n}{word[:i] + word[i + 1 : n]}" for n in range(4, len(word) + 1) for i in range(n)}
        if len(word) < LONG:
            last = left = {word}
            for _ in range(len(word) // 4):
                last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
                left = left | last
            asked |= {"-" + w for w in left}
            held |= {"-" + w for w in left}
    return asked, held


def similar_words(words: DataFrame) -> DataFrame:
    """(x, y): every ordered pair of the distinct ``word`` that can count as similar, cut short or not; each with itself too."""
    tasks = words.sparkSession.sparkContext.defaultParallelism * 4

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):  # a word has some hundred keys
                rows = []
                for word in batch["word"].iloc[at : at + 500]:
                    asked, held = word_keys(word)
                    rows += [(xxhash.xxh32_intdigest(k) - (1 << 31), word, k in asked, k in held) for k in asked | held]
                yield pd.DataFrame(rows, columns=["key", "word", "asked", "held"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def paired(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows[rows["key"].duplicated(keep=False)]
            codes, known = pd.factorize(rows["word"], sort=True)
            ask, hold = (pd.DataFrame({"key": rows["key"].to_numpy(), "code": codes})[rows[c].to_numpy()] for c in ("asked", "held"))
            both = ask.merge(hold, on="key")
            x, y = both["code_x"].to_numpy(), both["code_y"].to_numpy()
            low, high = np.divmod(np.unique((np.minimum(x, y) * len(known) + np.maximum(x, y))[x != y]), max(1, len(known)))
            return pd.DataFrame({"x": known.take(low), "y": known.take(high)})

        rest = []
        for batch in batches:
            if rest and batch["key"].iat[0] == batch["key"].iat[-1] == rest[0]["key"].iat[-1]:
                rest.append(batch)
                continue
            rows = pd.concat([*rest, batch])
            last = rows["key"].to_numpy().searchsorted(rows["key"].iat[-1])  # the last key's rows may go on in the next batch
            rest = [rows.iloc[last:]]
            yield paired(rows.iloc[:last])
        if rest:
            yield paired(pd.concat(rest))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[word_similarity((x, True), (y, True)) > 0 for x, y in zip(batch["x"], batch["y"])]]

    # one shuffle of what a word asks for and holds; keys that share a hash by chance only add pairs that are not near
    keys = words.repartition(tasks).mapInPandas(key, "key int, word string, asked boolean, held boolean")
    by_key = keys.repartition("key").sortWithinPartitions("key").mapInPandas(meet, "x string, y string")
    size = F.length("word")
    long_ = words.where(size >= LONG).select(F.col("word").alias("x"), F.explode(F.sequence(size - F.floor(size / 4), size)).alias("size"))
    blocks = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    by_size = long_.withColumn("salt", blocks).join(
        words.select(F.col("word").alias("y"), size.cast("long").alias("size"), F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int").alias("salt")), ["size", "salt"]
    )
    pairs_ = by_key.unionByName(by_size.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    met = cut(pairs_.distinct())
    found = cut(met.repartition(tasks).mapInPandas(near, "x string, y string"), after=[met])
    return found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(words.select(F.col("word").alias("x"), F.col("word").alias("y")))


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of readings that may be linked."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(id_, w) for id_, text in zip(batch["id"], batch["reading"]) for w in {w for w, _ in _tokens(text)[1]}], columns=["id", "word"])

    words = cut(distinct.select("id", "reading").mapInPandas(split, "id long, word string"))
    held = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    similar = cut(similar_words(held.select("word")).join(held.select(F.col("word").alias("y"), "n"), "y"))
    met = similar.groupBy(F.col("x").alias("word")).agg(F.sum("n").alias("met"))
    rarer = words.where(~F.col("word").isin(*KINDS)).join(met, "word").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("met", "word"))), 1, 2).alias("m"))
    # where the rarest word is met often, the next has to have a similar one too; hashes that agree by chance only add candidates
    rarest = rarer.select("id", F.get("m", F.lit(0))["word"].alias("x"), F.when(F.get("m", F.lit(0))["met"] > FEW, F.get("m", F.lit(1))["word"]).alias("next"))
    partners = similar.groupBy(F.col("x").alias("next")).agg(F.collect_list(F.hash("y")).alias("partners"))
    rarest = rarest.join(partners, "next", "left")
    blocks = F.ceil(F.col("n") / SMALL_BUCKET).cast("int")
    ask = rarest.join(similar, "x").select(F.col("id").alias("a"), F.col("y").alias("word"), "partners", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    has = words.groupBy("id").agg(F.collect_list(F.hash("word")).alias("has"))
    give = words.join(has, "id").join(held, "word").select("word", F.col("id").alias("b"), "has", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    met_by_two = ask.join(give, ["word", "block"]).where("a <> b and (partners is null or arrays_overlap(partners, has))")
    return met_by_two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame) -> DataFrame:
    """Adds the similarity to (a, b, ra, rb, …); distinct pairs only."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = [name_similarity(x, y) for x, y in zip(batch["ra"], batch["rb"])]
            yield batch

    fields = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)
    return pairs.mapInPandas(verify, f"{fields}, score double")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b, score), a < b: the pairs of readings that were candidates and verified."""
    todo = cut(candidates(distinct))
    texts = distinct.select("id", "reading")
    pairs_ = todo.join(texts.select(F.col("id").alias("a"), F.col("reading").alias("ra")), "a").join(texts.select(F.col("id").alias("b"), F.col("reading").alias("rb")), "b")
    return cut(_verified(pairs_).where(F.col("score") >= LINK_AT).select("a", "b", "score"))


def stars(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, star): greedy star cover. A vertex that outranks all its open neighbours becomes a centre; its open
    neighbours join the best centre they touch; the rest goes on. Each round settles at least one vertex of every
    component, and usually nearly all."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    degree = both.groupBy("x").agg(F.count(F.lit(1)).alias("deg"))
    rank = F.struct(F.col("deg"), (-F.col("x")).alias("neg"))
    ranks = degree.select(F.col("x"), rank.alias("r"))
    open_edges = cut(both.join(ranks, "x").join(ranks.select(F.col("x").alias("y"), F.col("r").alias("ry")), "y"))
    settled = vertices.join(degree.select(F.col("x").alias("id")), "id", "left_anti").select("id", F.col("id").alias("star"))
    done, pieces = None, [cut(settled)]
    while not open_edges.isEmpty():
        best = open_edges.groupBy("x").agg(F.max("ry").alias("top"), F.first("r").alias("r"))
        centres = best.where("r > top").select(F.col("x").alias("c"))
        joined = (
            open_edges.join(centres, open_edges["x"] == centres["c"]).groupBy("y").agg(F.max("r").alias("r"))
            .select(F.col("y").alias("id"), (-F.col("r.neg")).alias("star"))
        )
        done = cut(centres.select(F.col("c").alias("id"), F.col("c").alias("star")).unionByName(joined))
        pieces.append(done)
        left = open_edges.join(done.select(F.col("id").alias("x")), "x", "left_anti").join(done.select(F.col("id").alias("y")), "y", "left_anti")
        kept = cut(left)
        # vertices whose neighbours have all been settled stand alone
        alone = open_edges.select(F.col("x").alias("id")).distinct().join(done, "id", "left_anti").join(kept.select(F.col("x").alias("id")).distinct(), "id", "left_anti")
        pieces.append(cut(alone.select("id", F.col("id").alias("star"))))
        open_edges = kept
    out = pieces[0]
    for more in pieces[1:]:
        out = out.unionByName(more)
    return out


def entities(typed: DataFrame) -> DataFrame:
    """(entry_id, entity): the entity is the smallest entry_id that has the star's central reading."""
    entries, distinct = readings(typed)
    member = stars(links(distinct), distinct.select("id"))
    return entries.join(distinct.join(member, "id").select("reading", "star"), "reading").select("entry_id", F.col("star").alias("entity"))


def pairs(typed: DataFrame) -> DataFrame:
    """(entry_a, entry_b), entry_a < entry_b: every pair of entries of one entity."""
    member = cut(entities(typed))
    a = member.select("entity", F.col("entry_id").alias("entry_a"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    b = member.select("entity", F.col("entry_id").alias("entry_b"), F.pmod("entry_id", F.lit(SALTS)).cast("int").alias("salt"))
    return a.join(b, ["entity", "salt"]).where("entry_a < entry_b").select("entry_a", "entry_b")
