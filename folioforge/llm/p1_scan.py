"""Noise in text from scanned pages: furniture lines, words broken by line ends, misread letters.

Words are grouped by a skeleton of strokes, in which glyphs that scanners confuse come out alike; a rare form
yields to the frequent form of its group that its neighbours support. Lines are grouped by their text with the
digits masked; what keeps to page edges is furniture. Reading order, next lines and paragraphs are windows.

Lines are numbered from 0 after splitting at line feeds. Null and empty texts have no lines; blank lines give no
cases. A block without a paper is a document of its own. Repeated rows of one id count once. All statistics
are over every line given. Masks and pairs of words are counted by hashes of 64 bits, so that no text is shuffled for
its count; words with a rival are met behind a set of at most ``SIEVE`` hash values, and hot words, masks and
contexts are looked up apart from the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, lookup

#: fixed values: glyphs as strokes, so that n, u and ri, or m, rn and in, come out alike
STROKES = (("m", "iii"), ("n", "ii"), ("u", "ii"), ("w", "vv"), ("d", "ci"))
ALIKE = ("rl1|ecf6h059@", "iiiicctbbosga")
#: marks that break a word at a line's end
BREAKS = "-‐­¬"
#: a form is frequent against a rare one from these factors on, with and without support from its neighbours
FREQUENT, DOMINANT = 4, 60
#: furniture by corpus: least lines of a mask, and their least share at page edges; the same for a line's last words
MASK_LINES, MASK_SHARE, TAIL_LINES, TAIL_SHARE = 4, 0.6, 8, 0.8
EDGE, NARROW = 2, 0.85
#: hash values that a broadcast set of words can have
SIEVE = 1 << 20
AT = ("table_name", "rec_id", "line_no")


def skeleton(word: Column) -> Column:
    out = F.translate(F.lower(word), *ALIKE)
    for glyph, strokes in STROKES:
        out = F.replace(out, F.lit(glyph), F.lit(strokes))
    return out


def bare(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}@]+|[^\p{L}\p{N}@]+$", "")


def lines(papers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(table_name, rec_id, line_no, doc, seq, page, text): the non-blank lines in reading order."""
    split = papers.where("paper_id is not null").dropDuplicates(["paper_id"]).select("paper_id", F.posexplode(F.split("full_text", "\n")).alias("line_no", "text"))
    a = split.select(
        F.lit("papers").alias("table_name"), F.col("paper_id").alias("rec_id"), F.col("line_no").cast("long").alias("line_no"), F.concat(F.lit("p"), "paper_id").alias("doc"),
        F.struct(F.lit(0).alias("page"), F.col("line_no").cast("double").alias("y"), F.lit(0.0).alias("x"), F.lit(0).cast("long").alias("id")).alias("at"), F.lit(None).cast("int").alias("page"), "text",
    )
    order = F.struct(F.coalesce("page", F.lit(0)).alias("page"), F.coalesce(F.col("y0").cast("double"), F.lit(0.0)).alias("y"), F.coalesce(F.col("x0").cast("double"), F.lit(0.0)).alias("x"), F.col("block_id").alias("id"))
    b = blocks.where("block_id is not null").dropDuplicates(["block_id"]).select(
        F.lit("blocks").alias("table_name"), F.col("block_id").alias("rec_id"), F.lit(0).cast("long").alias("line_no"),
        F.coalesce(F.concat(F.lit("b"), "paper_id"), F.concat(F.lit("n"), "block_id")).alias("doc"), order.alias("at"), "page", F.regexp_replace("text", "\n", " ").alias("text"),
    )
    both = a.unionByName(b).where(F.col("text").rlike(r"[^\s\p{Z}]"))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("at"))).drop("at")


def _masked(text: Column) -> Column:
    """Lower case, numbers (also misread ones) as #, one space."""
    number = F.regexp_replace(text, r"(?<![\p{L}\p{N}])[OoIl|]*\d[\dOoIl|]*(?![\p{L}\p{N}])", "#")
    return F.trim(F.regexp_replace(F.lower(number), r"[\s\p{Z}\p{C}]+", " "))


PAGE_NUMBER = r"^[\[(–—-]? ?((page|pages|p|pg|seite)\.? ?)?(#|[ivxl]{1,6})( ?(of|/|-|von) ?#)? ?[\])–—-]?$"


def with_keys(text_lines: DataFrame) -> DataFrame:
    """The lines with ``sure`` (furniture by itself), ``open`` (perhaps furniture, by what the corpus says of its mask or tail), ``near`` a page's edge, ``repeated``, and the hashes ``key`` and ``tail``."""
    doc = Window.partitionBy("doc").orderBy("seq")
    whole = Window.partitionBy("doc")
    marked = (
        text_lines.withColumn("mask", _masked(F.col("text")))
        .withColumn("number", F.col("mask").rlike(PAGE_NUMBER))
        .withColumn("turn", F.col("text").startswith("\f") | F.coalesce(F.col("page") != F.lag("page").over(doc), F.lit(False)))
        .withColumn("last", F.col("seq") == F.max("seq").over(whole))
        .withColumn("nth", F.sum(F.when(F.col("number"), 0).otherwise(1)).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("skel", skeleton("mask"))
    )
    # the skeletons of a document's first two lines that are no page numbers
    first = (F.col("seq") <= 4) & ~F.col("number")
    # a page edge: a number, the end, the lines on both sides of a page's turn
    edge = (
        marked.withColumn("edge", F.col("number") | F.col("last") | F.col("turn") | F.coalesce(F.lead("turn").over(doc), F.lit(False)))
        .withColumn("title", F.max(F.when(first & (F.col("nth") == 1), F.col("skel"))).over(whole))
        .withColumn("authors", F.max(F.when(first & (F.col("nth") == 2), F.col("skel"))).over(whole))
    )
    close = edge.withColumn("near", F.max(F.col("edge").cast("int")).over(doc.rowsBetween(-EDGE, EDGE)) > 0)
    # a running head is the title or the authors, perhaps cut short, perhaps with a page number
    stripped = F.trim(F.regexp_replace("mask", r"(\s+[\[(–—-]?\s?(#|p\. ?#|page #|# of #|[ivx]{1,4})\s?[\])–—-]?)$|^([\[(–—-]?\s?(p\. ?|page )?#( of #)?\s?[\])–—-]?\s+)(?=\D{6})", ""))
    # it begins as they do, or with what may be taken off
    begins = [F.startswith("skel", F.left(F.col(c), F.lit(2))) for c in ("title", "authors")]
    head = F.when((F.col("seq") > 2) & (begins[0] | F.coalesce(begins[1], F.lit(False)) | F.col("mask").rlike(r"^[\[(–—#-]|^p(\.|age )")), stripped)
    held = close.withColumn("head", head).withColumn("stem", skeleton(F.regexp_replace("head", r"\s*(\.\.\.|…)$", ""))).withColumn("is_cut", F.col("head").rlike(r"(\.\.\.|…)$"))
    titled = (F.col("stem") == F.col("title")) | (F.col("is_cut") & (F.length("stem") > 8) & F.expr("startswith(title, stem)"))
    titled = titled | (F.col("near") & (F.length("stem") > 15) & F.expr("startswith(title, concat(stem, ' '))"))
    authored = (F.col("stem") == F.col("authors")) | (F.col("head").rlike(r" et al\.?$") & F.expr("startswith(authors, regexp_replace(stem, ' ct ai[.]?$', ''))"))
    running = F.coalesce((F.col("seq") > 2) & (titled | authored), F.lit(False))
    words = F.split("mask", " ")
    tail = skeleton(F.array_join(F.slice(F.reverse(words), 1, 3), " "))
    sentence_end = F.col("mask").rlike(r"[a-z)][.?!;:]$") & ~F.col("mask").rlike(r"al\.$")
    # a text line that ends no sentence is about as wide as the document's lines
    width = F.percentile_approx(F.length("text"), 0.9).over(whole)
    narrow = (F.col("seq") > 2) & ~sentence_end & (F.length("text") < NARROW * width)
    keyed = (
        held.withColumn("sure", F.col("number") | running).withColumn("open", ~F.col("sure") & narrow)
        .withColumn("key", F.xxhash64("skel")).withColumn("tail", F.when(F.size(words) > 3, F.xxhash64(tail)))
    )
    again = F.sum(F.when(F.col("near"), 1).otherwise(0)).over(Window.partitionBy("doc", "key"))
    times = F.count(F.lit(1)).over(Window.partitionBy("doc", "key"))
    return keyed.withColumn("repeated", (F.col("seq") > 2) & (times >= 3) & (again == times)).select(*AT, "doc", "seq", "text", "sure", "open", "near", "repeated", "key", "tail")


def by_corpus(keyed: DataFrame) -> DataFrame:
    """(AT, doc, seq) of the open lines that are furniture: their mask keeps to page edges, or they are at an edge and their tail does, or their document repeats them there."""
    share, n = F.avg(F.col("near").cast("double")), F.count(F.lit(1))
    masks = keyed.groupBy("key").agg(n.alias("n"), share.alias("s")).where((F.col("n") >= MASK_LINES) & (F.col("s") >= MASK_SHARE)).select("key", "n")
    tails = keyed.where("tail is not null").groupBy("tail").agg(n.alias("n"), share.alias("s")).where((F.col("n") >= TAIL_LINES) & (F.col("s") >= TAIL_SHARE)).select("tail", "n")
    total = keyed.count()
    open_, ids = keyed.where("open"), [*AT, "doc", "seq"]
    by_mask = lookup(open_.select(*ids, "key"), cut(masks), ["key"], "n", total)
    by_tail = lookup(open_.where("near").select(*ids, "tail"), cut(tails), ["tail"], "n", total)
    return by_mask.select(*ids).unionByName(by_tail.select(*ids)).unionByName(open_.where("repeated and near").select(*ids)).distinct()


def text_lines(keyed: DataFrame, furniture: DataFrame, with_text: bool = False) -> DataFrame:
    """The lines of the text: their words, the last word before and the first after them, and the broken word at their end (``left``, ``right``).

    ``broken``: the last word goes on in the next line; ``rest``: the first word is what a broken one goes on with;
    ``follow``: the next line's first token, as it stands.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in keyed.dtypes if c not in (*AT, "doc", "seq")]
    both = keyed.where("not sure").withColumn("gone", F.lit(False)).unionByName(furniture.select(*AT, "doc", "seq", *none, F.lit(True).alias("gone")))
    here = both.repartition("doc").withColumn("gone", F.max("gone").over(Window.partitionBy("doc", "seq"))).where("not gone and text is not null")
    text = here.withColumn("parts", F.filter(F.split(F.col("text"), r"[\s\p{Z}\f]+"), lambda t: t != "")).where("size(parts) > 0")
    doc = Window.partitionBy("doc").orderBy("seq")
    ends, starts = F.element_at("parts", -1), F.element_at("parts", 1)
    cutting = ends.rlike(rf"\p{{L}}[{BREAKS}]$")
    follows = F.col("follow")
    opened = follows.rlike(r"^[\p{Ll}@0-9][\p{L}@0-9-]*") | (ends.rlike(r"\p{Lu}[‐­¬-]$") & follows.rlike(r"^\p{L}"))
    suspended = ends.rlike(r"[-‐]$") & F.regexp_replace(F.lower(follows), r"[^\p{L}]", "").isin("and", "or", "und", "oder", "et", "ou")
    left = F.regexp_replace(F.regexp_replace(F.lower(ends), rf"[{BREAKS}]$", ""), r"^[^\p{L}\p{N}@]+", "")
    right = F.regexp_replace(F.lower(follows), r"[^\p{L}\p{N}@]+$", "")
    out = (
        text.withColumn("follow", F.lead(starts).over(doc)).withColumn("before", F.lag(ends).over(doc))
        .withColumn("broken", F.coalesce(cutting & opened & ~suspended, F.lit(False)))
        .withColumn("rest", F.coalesce(F.lag("broken").over(doc), F.lit(False)))
        .withColumn("left", F.when(F.col("broken"), left)).withColumn("right", F.when(F.col("broken"), right))
        .withColumn("words", F.transform("parts", bare)).withColumn("prev", bare(F.col("before"))).withColumn("next", bare(follows))
    )
    return out.select(*AT, "doc", "seq", "words", "prev", "next", "broken", "rest", "left", "right", *(["text", "parts", "follow"] if with_text else []))


def _whole() -> Column:
    """The places (from 1) of a line's words that are neither broken nor the rest of a broken one."""
    first, last = F.when(F.col("rest"), 2).otherwise(1), F.size("words") - F.when(F.col("broken"), 1).otherwise(0)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


WORDLIKE = r"\p{L}|@"


def vocabulary(page: DataFrame) -> DataFrame:
    """(word, n, skel): the words that stand whole."""
    word = page.select(F.explode(F.transform(_whole(), lambda i: F.element_at("words", i))).alias("word")).where(F.col("word").rlike(WORDLIKE))
    return word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("skel", skeleton("word"))


def pairs_of_words(page: DataFrame) -> DataFrame:
    """(h, c): how often each two words follow each other, by the hash of both."""
    before = F.concat(F.array("prev"), F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))))
    hashed = F.zip_with(before, "words", lambda a, b: F.when(a.isNotNull(), F.xxhash64(a, b)))
    return page.select(F.explode(hashed).alias("h")).where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("c"))


def _clean(word: Column) -> Column:
    return word.rlike(r"^\p{L}+(['’-]\p{L}+)*$")


def rivals(vocab: DataFrame) -> DataFrame:
    """(word, n, form, m): the frequent forms that a rare word may stand for."""
    frequent = vocab.where(_clean(F.col("word"))).select(F.col("word").alias("form"), F.col("n").alias("m"), "skel")
    # of a skeleton's forms, those that are not themselves rare beside another
    top = Window.partitionBy("skel")
    frequent = frequent.withColumn("most", F.max("m").over(top)).where(F.col("m") * FREQUENT >= F.col("most")).drop("most")
    near = F.levenshtein("word", "form", 4)
    pairs = vocab.join(frequent, "skel").where((F.col("word") != F.col("form")) & (F.col("m") >= F.col("n") * F.when(_clean(F.col("word")), FREQUENT).otherwise(1)) & (F.col("m") >= 3))
    return pairs.where(near.between(1, 4)).select("word", "n", "form", "m")


def misread(page: DataFrame, vocab: DataFrame) -> DataFrame:
    """(AT, doc, seq, tok, word, form): the whole words that are misread, with the form their context supports.

    The judgement is made once for each context (word before, word, word after), however often it occurs.
    """
    rival = cut(rivals(vocab))
    sieve = rival.select(F.pmod(F.xxhash64("word"), F.lit(SIEVE)).alias("slot")).distinct()  # at most SIEVE numbers
    at = F.transform(_whole(), lambda i: F.struct((i - 1).alias("tok"), F.element_at("words", i).alias("word"),
        F.when(i > 1, F.try_element_at("words", i - 1)).otherwise(F.col("prev")).alias("prev"), F.coalesce(F.try_element_at("words", i + 1), F.col("next")).alias("next")))
    word = page.select(*AT, "doc", "seq", F.explode(at).alias("w")).select(*AT, "doc", "seq", "w.*")
    some = word.join(F.broadcast(sieve), F.pmod(F.xxhash64("word"), F.lit(SIEVE)) == F.col("slot"), "left_semi")
    many = rival.groupBy("word").agg(F.max("n").alias("n"), F.collect_list(F.struct("form", "m")).alias("forms"))
    total = vocab.agg(F.sum("n")).first()[0] or 0
    suspect = cut(lookup(some, many.withColumn("times", F.col("n")), ["word"], "times", total))
    context = cut(suspect.groupBy("word", "prev", "next").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("forms").alias("forms")).withColumn("id", F.xxhash64("word", "prev", "next")))
    each = context.select("id", "word", "prev", "next", F.inline("forms"))
    ask = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), F.xxhash64(a, b).alias("h")) for name, a, b in (("s1", "prev", "form"), ("s2", "form", "next"), ("o1", "prev", "word"), ("o2", "word", "next"))]))
    asked = cut(each.select("id", "form", ask.alias("a")).select("id", "form", "a.side", "a.h"))
    known = pairs_of_words(page).join(asked.groupBy("h").agg(F.count(F.lit(1)).alias("asks")), "h")
    met = lookup(asked, cut(known), ["h"], "asks", asked.count())
    found = met.groupBy("id", "form").agg(*[F.sum(F.when(F.col("side") == side, F.col("c")).otherwise(0)).alias(side) for side in ("s1", "s2", "o1", "o2")])
    judged = context.select("id", "word", "prev", "next", "n", "times", F.inline("forms")).join(found, ["id", "form"], "left").na.fill(0, ["s1", "s2", "o1", "o2"])
    backed = F.col("s1") + F.col("s2")
    own = F.greatest(F.col("o1") - 1, F.lit(0)) + F.greatest(F.col("o2") - 1, F.lit(0))
    odd = ~_clean(F.col("word"))
    accepted = judged.where((backed > own * 2) | (F.col("m") >= F.col("n") * DOMINANT) & (backed >= own) | odd)
    best = accepted.groupBy("id").agg(F.max_by("form", F.struct(backed, "m", "form")).alias("form"), F.max("times").alias("times"))
    here = suspect.select(*AT, "doc", "seq", "tok", "word", F.xxhash64("word", "prev", "next").alias("id"))
    return lookup(here, cut(best), ["id"], "times", total).drop("id")


def mended(page: DataFrame, vocab: DataFrame) -> DataFrame:
    """(AT, doc, seq, tok, fixed): the whole words of the broken ones, found once for each two parts.

    Of the joined and the hyphenated reading the more frequent word wins, each first taken as it is, then by
    the frequent form of its skeleton; a word that nothing else has is joined.
    """
    broken = page.where("broken").select(*AT, "doc", "seq", (F.size("words") - 1).alias("tok"), "left", "right")
    parts = cut(broken.groupBy("left", "right").agg(F.count(F.lit(1)).alias("times")))
    readings = parts.withColumn("r", F.explode(F.array(F.struct(F.lit(1).alias("plain"), F.concat("left", "right").alias("w")), F.struct(F.lit(0).alias("plain"), F.concat("left", F.lit("-"), "right").alias("w"))))).select("left", "right", "times", "r.plain", "r.w")
    forms = vocab.where(_clean(F.col("word")))
    exact = forms.select(F.col("word").alias("w"), "n")
    best = forms.groupBy("skel").agg(F.max_by("word", F.struct("n", "word")).alias("form"), F.max("n").alias("m"))
    both = readings.join(exact, "w", "left").withColumn("skel", skeleton("w")).join(best, "skel", "left").na.fill(0, ["n", "m"])
    use_form = (F.col("m") >= F.col("n") * FREQUENT) & (F.col("m") > 0) & (F.levenshtein(F.col("w"), F.col("form")) <= 4)
    scored = both.withColumn("fixed", F.when(use_form, F.col("form")).otherwise(F.col("w"))).withColumn("score", F.when(use_form, F.col("m")).otherwise(F.col("n")))
    fixed = cut(scored.groupBy("left", "right").agg(F.max_by("fixed", F.struct("score", "plain")).alias("fixed"), F.max("times").alias("times")))
    total = fixed.agg(F.sum("times")).first()[0] or 0
    return lookup(broken, fixed, ["left", "right"], "times", total).drop("left", "right")


def repaired(papers: DataFrame, blocks: DataFrame, with_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The places of the furniture, the text lines, the misread words and the mended ones."""
    keyed = cut(with_keys(lines(papers, blocks)))
    by_masks = cut(by_corpus(keyed))
    furniture = cut(keyed.where("sure").select(*AT).unionByName(by_masks.select(*AT)))
    page = cut(text_lines(keyed, by_masks, with_text), after=[keyed])
    vocab = cut(vocabulary(page))
    return furniture, page, misread(page, vocab), mended(page, vocab)


def found(papers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(table_name, rec_id, line_no, kind, fixed): furniture, hyphen and ocr cases."""
    furniture, _, wrong, whole = repaired(papers, blocks)
    a = furniture.select(*AT, F.lit("furniture").alias("kind"), F.lit("").alias("fixed"))
    b = whole.select(*AT, F.lit("hyphen").alias("kind"), "fixed")
    c = wrong.select(*AT, F.lit("ocr").alias("kind"), F.col("form").alias("fixed"))
    return a.unionByName(b).unionByName(c).distinct()


def paragraphs(papers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, para, text): the text without furniture, words mended, lines reflowed.

    A paragraph ends before and after a numbered heading, and where a line well short of the document's
    usual width ends a sentence.
    """
    _, page, wrong, whole = repaired(papers, blocks, with_text=True)
    fixes = wrong.select("doc", "seq", "tok", F.col("form").alias("fix")).unionByName(whole.select("doc", "seq", "tok", F.col("fixed").alias("fix")))
    by_line = fixes.groupBy("doc", "seq").agg(F.map_from_entries(F.collect_list(F.struct("tok", "fix"))).alias("fixes"))

    def word(raw: Column, i: Column) -> Column:
        fix = F.try_element_at("fixes", i)
        last = F.col("broken") & (i == F.size("parts") - 1)
        capital = F.regexp_replace(raw, r"^[^\p{L}]+", "").rlike(r"^\p{Lu}")
        cased = F.when(capital, F.concat(F.upper(F.substring(fix, 1, 1)), F.substr(fix, F.lit(2)))).otherwise(fix)
        tail = F.regexp_extract(F.when(last, F.coalesce(F.col("follow"), F.lit(""))).otherwise(raw), r"([^\p{L}\p{N}@]*)$", 1)
        return F.when(fix.isNull(), raw).otherwise(F.concat(F.regexp_extract(raw, r"^([^\p{L}\p{N}@]*)", 1), cased, tail))

    out = F.transform("parts", word)
    line = F.array_join(F.when(F.col("rest"), F.slice(out, 2, F.size("parts"))).otherwise(out), " ")
    kept = page.join(by_line, ["doc", "seq"], "left").select("doc", "seq", "text", line.alias("line")).where("line <> ''")
    doc = Window.partitionBy("doc").orderBy("seq")
    width = F.percentile_approx(F.length("text"), 0.9).over(Window.partitionBy("doc"))
    heading = F.col("text").rlike(r"^\s*\d+(\.\d+)*\.?\s+\p{Lu}[\p{L} ]{2,40}$")
    ended = F.col("text").rlike(r"[.!?][\"”’)]*\s*$") & (F.length("text") < width * 0.8)
    new = heading | F.coalesce(F.lag(heading).over(doc), F.lit(True)) | F.coalesce(F.lag(ended).over(doc), F.lit(True)) | (F.col("seq") <= 2)
    numbered = kept.withColumn("new", new.cast("int")).withColumn("para", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("doc", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), " ").alias("text"))
