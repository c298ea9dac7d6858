"""Text, token, chunk and vector queries."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.checks import sqltext as q, standins as s
from gradeframe.checks.registry import Tables, check
from gradeframe.functions import text as tx, vectors as vx
from gradeframe.operators import error_rates as er, pages as pg, spelling
from gradeframe.operators.skew import salted_left_join


@check("normalized_text", "H1", f"SELECT doc_id, {q.normalize('text')} AS cleaned FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.normalize(F.col("text")).alias("cleaned"))


_WORD_SQL = (
    "list_transform({words}, lambda w: CASE "
    + " ".join(
        f"WHEN trim(lower(w), '.,;:!?()[]\"''') = {q.quoted(bad)} "
        f"THEN replace(w, {q.quoted(bad)}, {q.quoted(good)})"
        for bad, good in fv.OCR_WORD_FIXES.items()
    )
    + " ELSE w END)"
)
_NOISY = r"replace(replace(replace(replace({x}, ' la ', ' recieve, '), ' the ', ' Databse  sucess. '), 'on ', '0n '), ' o', ' 0')"
_FIXED = (
    r"regexp_replace(regexp_replace(noisy, '(^|[^a-zA-Z0-9_\x80-\x{10FFFF}])0([a-zA-Z])', '\1o\2', 'g'), "
    r"'([a-zA-Z])0([^a-zA-Z0-9_\x80-\x{10FFFF}]|$)', '\1o\2', 'g')"
)


@check(
    "recognition_fixes", "H2 C12",
    f"WITH n AS (SELECT doc_id, {_NOISY.format(x='text')} AS noisy FROM documents) "
    f"SELECT doc_id, array_to_string({_WORD_SQL.format(words=q.words(_FIXED))}, ' ') AS fixed FROM n",
)
def _(t: Tables) -> DataFrame:
    noisy = F.col("text")
    for old, new in ((" la ", " recieve, "), (" the ", " Databse  sucess. "), ("on ", "0n "), (" o", " 0")):
        noisy = F.replace(noisy, F.lit(old), F.lit(new))
    return t.documents.select("doc_id", tx.fix_confusions(noisy).alias("fixed"))


@check(
    "sentences", "H3",
    rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents)
    SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS sentence FROM (
      SELECT doc_id, list_filter(list_transform(l, lambda x: {q.strip('x')}), lambda x: x <> '') AS l FROM p)""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")
    )


@check(
    "tokens", "H4",
    rf"""SELECT doc_id, len(k) AS n, array_to_string(k, ' ') AS tokens FROM (
      SELECT doc_id, list_filter(list_transform({q.words('lower(text)')},
        lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')),
        lambda w: regexp_full_match(w, '\p{{L}}+') AND w NOT IN {q.in_list(fv.KEYWORD_STOP_WORDS)}) AS k FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    k = tx.tokens(F.col("text"), fv.KEYWORD_STOP_WORDS)
    return t.documents.select("doc_id", k.alias("k")).select(
        "doc_id", F.size("k").cast("long").alias("n"), F.array_join("k", " ").alias("tokens")
    )


@check(
    "real_word_counts", "H39",
    rf"SELECT doc_id, len({q.words('text')}) AS words, "
    rf"len(list_filter({q.words('text')}, lambda w: regexp_matches(w, '\p{{L}}'))) AS real_words FROM documents",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", tx.word_count(F.col("text")).cast("long").alias("words"),
        tx.real_word_count(F.col("text")).cast("long").alias("real_words"),
    )


@check(
    "label_clean_up", "H40",
    rf"SELECT doc_id, regexp_replace(regexp_replace({q.strip('t')}, '\s+', ' ', 'g'), '\s([?.!,;:])', '\1', 'g') AS label "
    r"FROM (SELECT doc_id, replace(replace(text, ', ', ' ,  '), '.', ' .') AS t FROM documents)",
)
def _(t: Tables) -> DataFrame:
    spaced = F.replace(F.replace("text", F.lit(", "), F.lit(" ,  ")), F.lit("."), F.lit(" ."))
    return t.documents.select("doc_id", tx.normalize_label(spaced).alias("label"))


@check(
    "discretized_scores", "H41",
    """SELECT event_id, round_even(CAST(trunc(value / 0.5) AS INT) * 0.5::DOUBLE * 10, 0)::INT AS step FROM events""",
)
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", tx.discretize(F.col("value")).alias("step"))


@check(
    "previews", "B6",
    """SELECT doc_id, left(text, 10000) AS stored,
      CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS preview FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", tx.left_chars(F.col("text"), 10000).alias("stored"),
        tx.preview(F.col("text")).alias("preview"),
    )


def _chunk_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return (
        f"SELECT doc_id, i::INT AS chunk_no, substr(text, i * {step} + 1, {size}) AS chunk FROM ("
        f"SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - {size})::DOUBLE / {step})::BIGINT) + 1)) AS i "
        "FROM documents)"
    )


@check("chunks_plain", "H25", _chunk_sql(5000, 0))
def _(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.posexplode(tx.chunks(F.col("text"), 5000)).alias("chunk_no", "chunk")
    )


@check("chunks_overlapping", "H25", _chunk_sql(8000, 500))
def _(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.posexplode(tx.chunks(F.col("text"), 8000, 500)).alias("chunk_no", "chunk")
    )


@check(
    "typed_pages", "H28",
    rf"""SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS page FROM (
      SELECT doc_id, list_filter(list_transform(string_split(
        regexp_replace(replace(replace(text, chr(10) || 'T', chr(10) || chr(10) || chr(10) || 'T'), chr(10) || 'E', chr(12) || 'E'),
          '\f|\n{{3,}}', chr(1), 'g'), chr(1)), lambda x: {q.strip('x')}), lambda x: x <> '') AS l FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    typed = F.replace(
        F.replace("text", F.lit("\nT"), F.lit("\n\n\nT")), F.lit("\nE"), F.lit("\fE")
    )
    return t.documents.select("doc_id", F.posexplode(tx.page_texts(typed)).alias("pos", "page"))


@check(
    "paper_slugs", "A21",
    r"""SELECT p_partkey, left(trim(regexp_replace(regexp_replace(trim(
      CASE WHEN p_size % 10 = 0 THEN 'UNKNOWN' ELSE p_brand END || '_' || p_name || ' & ' || p_type || '_' ||
      CASE WHEN p_size % 2 = 0 THEN '' ELSE 'Set-A' END, '_'), '[^A-Za-z0-9_\-]', '_', 'g'), '_+', '_', 'g'), '_'), 180) AS slug
    FROM part""",
)
def _(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        tx.slug(
            F.when(F.col("p_size") % 10 != 0, F.col("p_brand")),
            F.concat("p_name", F.lit(" & "), "p_type"),
            F.when(F.col("p_size") % 2 == 0, "").otherwise("Set-A"),
        ).alias("slug"),
    )


# --- vectors -----------------------------------------------------------------


@check(
    "label_cosine", "H18",
    """WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: 0) AS z FROM embeddings GROUP BY label),
    m AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
    centre AS (SELECT label, list(v ORDER BY i) AS centre FROM m GROUP BY label)
    SELECT vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], centre))), 6) AS similarity
    FROM embeddings JOIN centre USING (label)""",
)
def _(t: Tables) -> DataFrame:
    vectors = t.embeddings
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    )
    centre = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("centre")
    )
    # few labels, one of which may hold much of the table: its vectors are spread over many tasks
    rows = vectors.filter("label is not null").select("vec_id", "label", "embedding")
    return salted_left_join(rows, centre, ["label"], ["vec_id"], 64).select(
        "vec_id",
        F.round(
            vx.similarity(F.lit("a"), F.lit("b"), F.col("embedding"), F.col("centre")), 6
        ).alias("similarity"),
    )


def _letter_vector(sentence):
    return F.transform(
        F.array(*[F.lit(c) for c in string.ascii_lowercase]),
        lambda c: (F.length(sentence) - F.length(F.replace(F.lower(sentence), c, F.lit("")))).cast("double"),
    )


def _letter_sentences(text):
    return F.transform(
        F.filter(tx.period_sentences(text), lambda x: x != ""),
        lambda x: F.struct(x.alias("sentence"), vx.unit(_letter_vector(x)).alias("vector")),
    )


def _matches(t: Tables) -> DataFrame:
    pairs = s.qa_pairs(t).select(
        "conv_id", "turn",
        _letter_sentences(tx.normalize(F.col("student"))).alias("ss"),
        _letter_sentences(tx.normalize(F.col("teacher"))).alias("ts"),
    )
    return pairs.select("conv_id", "turn", vx.best_matches(F.col("ss"), F.col("ts")).alias("m"))


_MATCH = f"""{q.QA}, n AS (SELECT conv_id, turn,
    list_filter(string_split({q.normalize('student')}, '. '), lambda x: x <> '') AS ss,
    list_filter(string_split({q.normalize('teacher')}, '. '), lambda x: x <> '') AS ts FROM qa),
  vec AS (SELECT conv_id, turn, sentence, pos, side,
      list_transform(string_split('{','.join(string.ascii_lowercase)}', ','), lambda c: (length(sentence) - length(replace(lower(sentence), c, '')))::DOUBLE) AS v
    FROM (SELECT conv_id, turn, 's' AS side, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM n
      UNION ALL SELECT conv_id, turn, 't', unnest(ts), generate_subscripts(ts, 1) FROM n)),
  sims AS (SELECT a.conv_id, a.turn, a.pos, b.pos AS tpos, coalesce(round(CASE WHEN list_sum(a.v) = 0 OR list_sum(b.v) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END, 9), 0) AS sim
    FROM vec a JOIN vec b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.side = 's' AND b.side = 't'),
  best AS (SELECT conv_id, turn, pos, max(sim) AS sim FROM sims GROUP BY ALL)"""


@check(
    "best_sentence_matches", "C10",
    f"WITH {_MATCH} SELECT conv_id, turn, (pos - 1)::INT AS pos, round(sim, 3) AS similarity FROM best",
)
def _(t: Tables) -> DataFrame:
    return vx.match_rows(_matches(t), ["conv_id", "turn"], "m").select(
        "conv_id", "turn", "pos", "similarity"
    )


@check(
    "overall_sentence_score", "H19",
    f"WITH {_MATCH} SELECT conv_id, turn, round(avg(sim), 3) AS overall FROM best GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    return _matches(t).select("conv_id", "turn", vx.overall_match(F.col("m")).alias("overall"))


# --- spelling and error rates ---------------------------------------------------


def _vocabulary(t: Tables) -> tuple[DataFrame, DataFrame]:
    counts = spelling.word_counts(t.conversations.select(tx.normalize(F.col("text")).alias("text")), "text")
    return counts, spelling.vocabulary(counts, 2000)


@check(
    "vocabulary", "C11",
    rf"""WITH w AS (SELECT unnest({q.words(q.normalize('text'))}) AS w FROM conversations),
    c AS (SELECT lower(l) AS word, count(*) AS n FROM (SELECT w, regexp_replace(w, '[^a-zA-Z]', '', 'g') AS l FROM w)
      WHERE length(l) > 2 AND NOT regexp_matches(w, '\d') AND l <> upper(l) GROUP BY 1)
    SELECT word, sum(n)::BIGINT AS n FROM (SELECT * FROM c WHERE n * 2000 >= (SELECT sum(n) FROM c)
      UNION ALL SELECT unnest([{', '.join(q.quoted(w) for w in fv.TECHNICAL_WORDS)}]), 1) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return _vocabulary(t)[1]


_CORRECTABLE = r"length(l) > 2 AND NOT regexp_matches(w, '\d') AND l <> upper(l)"
_FIXES = rf"""toks AS (SELECT conv_id, turn, generate_subscripts(k, 1) AS pos, unnest(k) AS w FROM (
    SELECT conv_id, turn, {q.words(q.normalize('text'))} AS k FROM conversations)),
  bare AS (SELECT *, regexp_replace(w, '[^a-zA-Z]', '', 'g') AS l FROM toks),
  cnt AS (SELECT lower(l) AS word, count(*) AS n FROM bare WHERE {_CORRECTABLE} GROUP BY 1),
  voc AS (SELECT word, sum(n) AS n FROM (SELECT * FROM cnt WHERE n * 2000 >= (SELECT sum(n) FROM cnt)
    UNION ALL SELECT unnest([{', '.join(q.quoted(w) for w in fv.TECHNICAL_WORDS)}]), 1) GROUP BY 1),
  near AS (SELECT c.word, v.word AS correction, v.n, damerau_levenshtein(c.word, v.word) AS d FROM cnt c JOIN voc v
    ON abs(length(c.word) - length(v.word)) <= 2 WHERE c.word NOT IN (SELECT word FROM voc)),
  fixes AS (SELECT word, correction FROM near WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, n DESC, correction) = 1)"""


@check("word_corrections", "C11", f"WITH {_FIXES} SELECT word, correction FROM fixes")
def _(t: Tables) -> DataFrame:
    return spelling.corrections(*_vocabulary(t))


@check(
    "corrected_texts", "C11 H46",
    rf"""WITH {_FIXES}, said AS MATERIALIZED (SELECT row_number() OVER () AS r, conv_id, turn, {q.words(q.normalize('text'))} AS k FROM conversations),
  cut AS (SELECT *, regexp_replace(w, '[^a-zA-Z]', '', 'g') AS l FROM (SELECT r, generate_subscripts(k, 1) AS pos, unnest(k) AS w FROM said)),
  done AS (SELECT r, pos, CASE WHEN correction IS NULL THEN w
        WHEN regexp_matches(l, '^[A-Z]') THEN replace(w, l, upper(correction[1]) || correction[2:]) ELSE replace(w, l, correction) END AS w
      FROM cut LEFT JOIN fixes ON {_CORRECTABLE} AND word = lower(l)),
  whole AS (SELECT r, string_agg(w, ' ' ORDER BY pos) AS text FROM done GROUP BY r)
    SELECT conv_id, turn, coalesce(text, '') AS text FROM said LEFT JOIN whole USING (r)""",
)
def _(t: Tables) -> DataFrame:
    fixes = spelling.corrections(*_vocabulary(t))
    texts = t.conversations.select("conv_id", "turn", tx.normalize(F.col("text")).alias("text"))
    return spelling.correct_texts(texts, ["conv_id", "turn"], "text", fixes)


_HYP = "replace(replace({ref}, 'ou', 'u'), 'er ', 'ur ')"


def _recognised(t: Tables) -> DataFrame:
    ref = tx.normalize(F.col("text"))
    rows = t.conversations.select("role", ref.alias("ref"))
    hyp = F.replace(F.replace("ref", F.lit("ou"), F.lit("u")), F.lit("er "), F.lit("ur "))
    return rows.select("role", "ref", hyp.alias("hyp"))


@check(
    "character_error_rate", "D24",
    f"""WITH r AS (SELECT role, {q.normalize('text')} AS ref FROM conversations),
    h AS (SELECT role, ref, {_HYP.format(ref='ref')} AS hyp FROM r)
    SELECT role, count(*) AS n_samples, sum(levenshtein(ref, hyp))::BIGINT AS edits, sum(length(ref))::BIGINT AS characters,
      round(sum(levenshtein(ref, hyp))::DOUBLE / sum(length(ref)), 8) AS cer FROM h GROUP BY role""",
)
def _(t: Tables) -> DataFrame:
    return er.character_error_rate(_recognised(t), "ref", "hyp", ["role"]).withColumn(
        "cer", F.round("cer", 8)
    )


@check(
    "word_error_rate", "D25",
    f"""WITH r AS (SELECT role, {q.normalize('text')} AS ref FROM conversations),
    h AS (SELECT role, {q.words('ref')} AS a, {q.words(_HYP.format(ref='ref'))} AS b FROM r)
    SELECT role, count(*) AS n_samples,
      round(sum(len(list_filter(list_zip(a, b), lambda p: p[1] <> p[2])))::DOUBLE / sum(len(a)), 8) AS wer FROM h GROUP BY role""",
)
def _(t: Tables) -> DataFrame:
    # the noise changes letters inside words only, so a word-by-word count is exact
    return er.error_rates(_recognised(t), "ref", "hyp", ["role"]).select(
        "role", "n_samples", F.round("wer", 8).alias("wer")
    )


@check(
    "corpus_tiers", "D26",
    """SELECT lang AS split, count(*) AS n_samples, CASE WHEN count(*) < 200 THEN 'small' WHEN count(*) < 800 THEN 'medium' ELSE 'large' END AS size_tier,
      CASE WHEN avg(n_chars) / 20000 < 0.08 THEN 'excellent' WHEN avg(n_chars) / 20000 < 0.12 THEN 'good'
        WHEN avg(n_chars) / 20000 < 0.2 THEN 'acceptable' ELSE 'poor' END AS quality FROM documents GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    rate = t.documents.groupBy(F.col("lang").alias("split")).agg((F.avg("n_chars") / 20000).alias("r"))
    sizes = er.split_sizes(t.documents, "lang").withColumnRenamed("lang", "split")
    return sizes.join(rate, "split").select(
        "split", "n_samples", er.size_tier(F.col("n_samples")).alias("size_tier"),
        er.quality_tier(F.col("r")).alias("quality"),
    )


@check(
    "page_scores", "H39 F1",
    rf"SELECT page_id, round(len(list_filter({q.words('html')}, lambda w: regexp_matches(w, '\p{{L}}'))) * 0.7::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE, 6) AS score FROM pages",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.round(pg.page_score(F.col("html"), F.lit(0.5)), 6).alias("score"))
