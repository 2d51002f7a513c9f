"""§2.14 composite flows (one callable each, built from the operators) and the
flagship query used by ``entry``.  Names avoid the reference's word for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions.arrays import age_range_expand, one_hot
from textprep.functions.text import text_normalize, text_normalize_v2
from textprep.operators import relational as R
from textprep.operators.aggregates import (
    corr_matrix,
    distinct_first_seen_ids,
    group_collect,
    label_encode_sorted,
    null_counts,
)
from textprep.operators.features import standard_scale
from textprep.operators.metrics import accuracy_micro, bleu_corpus
from textprep.operators.models import assemble, boosted_trees, decision_tree, random_forest, tabular_logreg
from textprep.operators.order import ffill_laid, ordered_layout
from textprep.operators.sampling import class_cap_rebalance, split_fraction, split_ordered, split_three_way
from textprep.operators.vocab import bpe_train, subword_encode, unigram_train, word_table, wordpiece_train
from textprep.plans import fixtures_sql as X
from textprep.plans import sql as S
from textprep.plans.catalog import register
from textprep.plans.q_arrays import spelling_sql
from textprep.plans.q_sampling import split_sql
from textprep.session import ensure_checkpoint_dir
from textprep.sources import files as FS
from textprep.sources import tables as TB
from textprep.sources.tables import table

SPECIALS = ("[PAD]", "[UNK]", "[SOS]", "[EOS]")
# Marker tokens of the spelling and the question tokenizer
SPELLING_SPECIALS = ("[PAD]", "[UNK]", "[SOS]", "[EOS]", "[RS]", "[WS]", "[MASK]", "[CLS]")
QUESTION_SPECIALS = ("[PAD]", "[UNK]", "[SOS]", "[EOS]", "[MASK]")


# --- flagship (entry) ---------------------------------------------------------------------

def flagship(spark, sf):
    """documents -> text_normalize -> drop empty -> 80/20 seeded split ->
    first-seen language ids learned on train -> lookup join."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", text_normalize(F.col("text")).alias("clean"))
    # the split and the codes read this frame several times: clean once, into a scratch table
    path = FS.scratch_path(spark, "clean")
    docs.write.parquet(path)
    docs = spark.read.schema(docs.schema).parquet(path).where(F.col("clean") != "")
    parts = split_fraction(docs, "doc_id", 0.2, 42)
    codes = distinct_first_seen_ids(parts.where(F.col("part") == "train"), "lang", "doc_id")
    codes = codes.select(F.col("value").alias("lang"), F.col("id").alias("lang_id"))
    return R.lookup_join(parts, codes, "lang").select("doc_id", "clean", "lang_id", "part")


def _clean_sql(src="documents", fn="text_normalize"):
    steps = S.chain(None, variant="A" if fn == "text_normalize" else "B")
    return S.cte_chain(src, "doc_id", "coalesce(CAST(text AS VARCHAR), '')", steps, "clean")


_FLAGSHIP_SQL = (
    f"WITH c AS ({_clean_sql()}), d AS (SELECT c.doc_id, c.clean, x.lang FROM c JOIN documents x USING (doc_id) "
    f"WHERE c.clean <> ''), p AS {split_sql(src='d')}, "
    "ids AS (SELECT lang, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS lang_id FROM p "
    "WHERE part = 'train' GROUP BY lang) SELECT p.doc_id, p.clean, ids.lang_id, p.part FROM p LEFT JOIN ids USING (lang)"
)


@register("text_clean_ids", _FLAGSHIP_SQL)
def _flagship(spark, sf):
    return flagship(spark, sf)


# --- tweet prep -------------------------------------------------------------------------

def _age_text():
    lo = F.floor(F.col("n_chars") / 1000).cast("int")
    return F.concat(lo.cast("string"), F.lit("-"), (lo + 9).cast("string"))


@register(
    "tweet_prep",
    f"WITH c AS ({_clean_sql()}), d AS (SELECT x.doc_id, x.lang, x.source, x.n_chars, concat('s', x.n_chars % 3) AS size_class, c.clean FROM documents x JOIN c USING (doc_id) "
    "WHERE x.text IS NOT NULL AND x.lang IS NOT NULL AND x.source IS NOT NULL AND x.n_chars IS NOT NULL), "
    f"p AS {split_sql(src='d')}, "
    "li AS (SELECT lang, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS lang_id FROM p WHERE part = 'train' GROUP BY lang), "
    "si AS (SELECT source, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS source_id FROM p WHERE part = 'train' GROUP BY source), "
    "zi AS (SELECT size_class, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS size_id FROM p WHERE part = 'train' GROUP BY size_class) "
    "SELECT p.doc_id, p.part, p.clean, li.lang_id, si.source_id, zi.size_id, CAST(generate_series(CAST(floor(n_chars / 1000) AS INTEGER), "
    "CAST(floor(n_chars / 1000) AS INTEGER) + 9) AS INTEGER[]) AS ages FROM p JOIN li USING (lang) JOIN si USING (source) JOIN zi USING (size_class) "
    "WHERE p.clean <> ''",
)
def tweet_prep(spark, sf):
    # scan: CSV written in latin-1, read back with the encoding fallback
    src = FS.scratch_path(spark, "tweets-latin1")
    FS.write_csv(table(spark, sf, "documents"), src, encoding="ISO-8859-1")
    raw = FS.read_csv_fallback(spark, src, "doc_id bigint, text string, lang string, source string, n_chars bigint", multi_line=True)
    rows = R.dropna_any(raw).withColumn("size_class", F.concat(F.lit("s"), (F.col("n_chars") % 3).cast("string")))
    parts = split_fraction(rows, "doc_id", 0.2, 42)
    train = parts.where(F.col("part") == "train")
    lang_ids = distinct_first_seen_ids(train, "lang", "doc_id")
    source_ids = distinct_first_seen_ids(train, "source", "doc_id")
    size_ids = distinct_first_seen_ids(train, "size_class", "doc_id")
    out = parts.select("doc_id", "part", "lang", "source", "size_class", text_normalize(F.col("text")).alias("clean"),
                       age_range_expand(_age_text()).alias("ages"))
    out = R.map_values_strict(out, "lang", lang_ids, out="lang_id")
    out = R.map_values_strict(out, "source", source_ids, out="source_id")
    out = R.map_values_strict(out, "size_class", size_ids, out="size_id")
    out = out.select("doc_id", "part", "clean", "lang_id", "source_id", "size_id", "ages")
    # sinks: cleaned CSV + code tables as JSON; the CSV is what later stages read
    dst = FS.scratch_path(spark, "tweets-clean")
    FS.write_csv(out, dst)
    maps = {"lang": lang_ids, "source": source_ids, "size": size_ids}
    FS.write_mapping_json({f"{k}2id": t for k, t in maps.items()} | {f"id2{k}": t for k, t in maps.items()}, FS.scratch_path(spark, "tweets-maps"))
    back = FS.read_csv(spark, dst, "doc_id bigint, part string, clean string, lang_id int, source_id int, size_id int, ages string")
    # an empty cleaned text is written as an empty field and comes back null: dropped
    back = back.where(F.col("clean").isNotNull() & (F.col("clean") != ""))
    return back.withColumn("ages", F.from_json("ages", "array<int>"))


# --- POS tagging prep -------------------------------------------------------------------

DROP_POS = ("F",)  # POS values filtered before numbering (the fixture's stand-in for punctuation tags)
_POS_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register(
    "pos_tagging_prep",
    f"WITH t AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos FROM {X.SPARSE_TOKENS}), "
    "f AS (SELECT * FROM t WHERE coalesce(pos_tag NOT IN ('F'), true)), "
    "ti AS (SELECT tag, CAST(row_number() OVER (ORDER BY min(pos)) - 1 AS INTEGER) AS tag_id FROM f WHERE tag IS NOT NULL GROUP BY tag), "
    "pi AS (SELECT pos_tag, CAST(row_number() OVER (ORDER BY min(pos)) - 1 AS INTEGER) AS pos_id FROM f GROUP BY pos_tag), "
    "ff AS (SELECT pos, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("word", "tag", "pos_tag", "sentence"))
    + " FROM f WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT sentence, array_to_string(list(word ORDER BY pos), ' ') AS words, list(tag ORDER BY pos) AS tags, "
    "list(pos_tag ORDER BY pos) AS pos_tags, list(tag_id ORDER BY pos) AS tag_ids, list(pos_id ORDER BY pos) AS pos_ids "
    "FROM ff LEFT JOIN ti USING (tag) LEFT JOIN pi USING (pos_tag) WHERE sentence IS NOT NULL GROUP BY sentence",
)
def pos_tagging_prep(spark, sf):
    toks = TB.sparse_key_tokens(spark, sf)
    kept = R.filter_not_in(toks, "pos_tag", DROP_POS)
    # one range-partitioned, checkpointed layout serves every order-dependent step:
    # its ``_seq`` is a single bigint that is monotone in the token order
    laid = ordered_layout(kept, _POS_ORDER)
    tag_ids = distinct_first_seen_ids(laid, "tag", "_seq").select(F.col("value").alias("tag"), F.col("id").alias("tag_id"))
    pos_ids = distinct_first_seen_ids(laid, "pos_tag", "_seq").select(F.col("value").alias("pos_tag"), F.col("id").alias("pos_id"))
    filled = ffill_laid(laid, ["sentence", "word", "pos_tag", "tag"])
    coded = R.lookup_join(R.lookup_join(filled, tag_ids, "tag"), pos_ids, "pos_tag")
    g = group_collect(coded, "sentence", ["_seq"], ["word", "tag", "pos_tag", "tag_id", "pos_id"])
    return g.select(
        "sentence",
        F.array_join(F.col("_rows.word"), " ").alias("words"),
        F.col("_rows.tag").alias("tags"),
        F.col("_rows.pos_tag").alias("pos_tags"),
        F.col("_rows.tag_id").alias("tag_ids"),
        F.col("_rows.pos_id").alias("pos_ids"),
    )


# --- spelling prep ----------------------------------------------------------------------

def _spelling_parts(spark, sf):
    """Cleaned (doc_id, right_text, wrong_text, part), written once."""
    path = FS.scratch_path(spark, "spelling-jsonl")
    FS.write_jsonl(TB.syllable_annotations(spark, sf), path)
    ann = FS.read_jsonl(spark, path, "doc_id bigint, annotations array<struct<current_syllable:string, "
                                     "alternative_syllables:array<string>>>")
    right = F.array_join(F.transform("annotations", lambda a: R.pick_first_or_else(a["alternative_syllables"],
                                                                                   a["current_syllable"])), " ")
    wrong = F.array_join(F.transform("annotations", lambda a: a["current_syllable"]), " ")
    pairs = ann.select("doc_id", text_normalize(right).alias("right_text"), text_normalize(wrong).alias("wrong_text"))
    parts = split_three_way(pairs, "doc_id", 42)
    scratch = FS.scratch_path(spark, "spelling-pairs")  # cleaned once, read by the training and the encoding
    parts.write.parquet(scratch)
    return spark.read.schema(parts.schema).parquet(scratch)


@register(
    "spelling_prep_pairs",
    f"WITH r AS ({spelling_sql()}), a AS {split_sql(0.4, 42, 'r')}, h AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY "
    f"{X.bits('doc_id', '0', 43)}, doc_id) <= ceil(count(*) OVER () * 0.5) THEN 'test' ELSE 'validation' END AS held FROM a WHERE part = 'test') "
    "SELECT doc_id, right_text, wrong_text, coalesce(held, 'train') AS part FROM a LEFT JOIN h USING (doc_id)",
)
def spelling_prep_pairs(spark, sf):
    """What ``spelling_prep`` trains on and encodes."""
    return _spelling_parts(spark, sf)


@register("spelling_prep")
def spelling_prep(spark, sf):
    parts = _spelling_parts(spark, sf)
    vocab, _ = wordpiece_train(word_table(parts, "right_text"), 3000, SPELLING_SPECIALS)
    # the three texts of a pair are encoded in one pass
    texts = F.array(F.struct(F.lit("right").alias("side"), F.concat(F.lit("[SOS]"), "right_text").alias("t")),
                    F.struct(F.lit("wrong").alias("side"), F.col("wrong_text").alias("t")),
                    F.struct(F.lit("target").alias("side"), F.concat("right_text", F.lit("[EOS]")).alias("t")))
    sides = parts.select("doc_id", F.explode(texts).alias("x")).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), "x.side").alias("k"), "x.t")
    enc = subword_encode(sides, "k", "t", vocab, "wordpiece", length=64, specials=SPELLING_SPECIALS)
    enc = enc.select(F.substring_index("k", ":", 1).cast("bigint").alias("doc_id"), F.substring_index("k", ":", -1).alias("side"), "ids", "mask")
    wide = enc.groupBy("doc_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
                                       for s in ("right", "wrong", "target") for c in ("ids", "mask")])
    return parts.select("doc_id", "part").join(wide, "doc_id")


TRANSLATION_VOCAB = 5000  # entries of each side's BPE vocabulary, as in the reference


# --- translation prep -------------------------------------------------------------------

def _line_sql(role: str, col: str) -> str:
    return (f"(SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, line AS {col} FROM (SELECT conv_id, turn, regexp_replace(text, "
            f"'[\\r\\n]+', ' ', 'g') AS line FROM conversations WHERE role = '{role}') "
            "WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')")


def _translation_pairs(spark, sf):
    """Two line files -> aligned pairs -> ordered 90/10 split."""
    conv = table(spark, sf, "conversations")
    base = FS.scratch_path(spark, "translation")
    for role, name in (("user", "src"), ("assistant", "tgt")):
        side = conv.where(F.col("role") == role).select("conv_id", "turn", F.regexp_replace("text", "[\\r\\n]+", " ").alias("text"))
        side.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn").select("text") \
            .write.mode("overwrite").text(f"{base}/{name}")
    src = FS.read_text_lines(spark, f"{base}/src").select("file", "line_no", F.col("line").alias("text"))
    tgt = FS.read_text_lines(spark, f"{base}/tgt").select("file", "line_no", F.col("line").alias("text"))
    pairs = R.zip_align(src, tgt, ["file", "line_no"])
    return split_ordered(pairs, "idx", 0.9)


@register(
    "translation_prep_pairs",
    f"SELECT idx, src, tgt, CASE WHEN row_number() OVER (ORDER BY idx) <= floor(0.9 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS part "
    f"FROM {_line_sql('user', 'src')} JOIN {_line_sql('assistant', 'tgt')} USING (idx)",
)
def translation_prep_pairs(spark, sf):
    """What ``translation_prep`` trains on and encodes."""
    return _translation_pairs(spark, sf).select("idx", "src", "tgt", "part")


@register("translation_prep")
def translation_prep(spark, sf):
    """Aligned pairs -> a vocabulary per side -> shifted / padded ids -> a scoring
    function -> corpus BLEU."""
    pairs = _translation_pairs(spark, sf)
    train = pairs.where(F.col("part") == "train")
    coded = {}
    for side in ("src", "tgt"):
        vocab, merges = bpe_train(word_table(train, side), TRANSLATION_VOCAB, SPECIALS)
        forms = {"src": {"encoder": ("[SOS]", "[EOS]")}, "tgt": {"decoder": ("[SOS]", ""), "target": ("", "[EOS]")}}[side]
        for name, (head, tail) in forms.items():
            text = pairs.select("idx", F.concat(F.lit(head), F.translate(side, "_", " "), F.lit(tail)).alias("t"))
            coded[name] = subword_encode(text, "idx", "t", vocab, "bpe", merges, 128, specials=SPECIALS).select(
                "idx", F.col("ids").alias(name), F.col("mask").alias(f"{name}_mask"))
    scored = pairs.join(coded["encoder"], "idx").join(coded["decoder"], "idx").join(coded["target"], "idx")
    # trivial scoring function: the hypothesis is the source text itself
    bleu = bleu_corpus(scored.where(F.col("part") == "validation"), "idx", "src", "tgt").first()["bleu"]
    out = FS.scratch_path(spark, "translation-out")
    FS.write_csv(scored.select("idx", "part", "src", "tgt"), out)
    return scored.select("idx", "part", "encoder", "encoder_mask", "decoder", "decoder_mask", "target", "target_mask", F.lit(bleu).alias("val_bleu"))


# --- question balance -------------------------------------------------------------------

BALANCE_CAP = 300  # rows kept of the capped (majority) class in the registered flow


@register(
    "question_balance",
    "WITH lt AS (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL "
    "AND l.quality IS NOT NULL), kept AS (SELECT doc_id, text, quality FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rk "
    f"FROM lt WHERE quality = 1) WHERE rk <= {BALANCE_CAP} UNION ALL SELECT doc_id, text, quality FROM lt WHERE quality <> 1), "
    f"sh AS (SELECT *, row_number() OVER (ORDER BY {X.bits('doc_id', '0', 42)}, doc_id) - 1 AS idx FROM kept), "
    f"p AS {split_sql(src='sh')}, c AS ({_clean_sql('p', 'v2')}) "
    "SELECT p.doc_id, p.idx, p.part, c.clean, list_transform(range(2), lambda i: CASE WHEN i = p.quality THEN 1 ELSE 0 END) "
    "AS label_1h FROM p JOIN c USING (doc_id)",
)
def question_balance(spark, sf):
    lt = R.dropna_any(TB.labelled_texts(spark, sf).select("doc_id", "text", "quality"))
    bal = class_cap_rebalance(lt, "quality", 1, BALANCE_CAP, "doc_id", 42)
    parts = split_fraction(bal, "doc_id", 0.2, 42)
    return parts.select("doc_id", "idx", "part", text_normalize_v2(F.col("text")).alias("clean"),
                        one_hot(F.col("quality"), 2).alias("label_1h"))


@register("question_balance_encoded")
def question_balance_encoded(spark, sf):
    """``question_balance`` with the encoding: a Unigram vocabulary of the whole corpus,
    texts cut and padded to 64 ids."""
    path = FS.scratch_path(spark, "questions")
    question_balance(spark, sf).write.parquet(path)
    rows = spark.read.parquet(path)
    corpus = R.dropna_any(TB.labelled_texts(spark, sf).select("text", "quality"))
    vocab = unigram_train(word_table(corpus, "text"), 3000, QUESTION_SPECIALS)
    enc = subword_encode(rows.select("doc_id", "clean"), "doc_id", "clean", vocab, "unigram", length=64, specials=QUESTION_SPECIALS)
    return rows.select("doc_id", "idx", "part", "label_1h").join(enc, "doc_id")


# --- tabular prep -----------------------------------------------------------------------

TABULAR_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "qty_tax", "status_code")


def _tabular_parts(spark, sf):
    """(split rows, nulls before the drop, largest correlation)."""
    li = table(spark, sf, "lineitem")
    li = R.fillna_const(li, 0, ["l_quantity", "l_tax", "l_discount"])
    li = R.derive_sum(li, "qty_tax", "l_quantity", "l_tax")
    li = R.select_drop(li, drop=["l_shipdate"])
    flag = label_encode_sorted(li, "l_returnflag").select(F.col("value").alias("l_returnflag"), F.col("id").alias("flag_id"))
    li = R.lookup_join(li, flag, "l_returnflag")
    li = li.withColumn("status_code", R.map_values(F.col("l_linestatus"), {"O": 0, "F": 1}))
    audit = null_counts(li.select("l_quantity", "l_tax", "status_code")).agg(F.sum("n_null").alias("n")).first()["n"]
    li = R.dropna_any(li)
    corr = corr_matrix(li, TABULAR_FEATURES[:4], 6).agg(F.max(F.abs("r")).alias("m")).first()["m"]
    li = li.withColumn("row_key", F.concat_ws(":", *[F.col(c).cast("string") for c in _POS_ORDER]))
    return split_fraction(li, "row_key", 0.2, 42), audit, corr


def _tabular_sql() -> str:
    key = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in TABULAR_FEATURES)
    scaled = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}_z" for c in TABULAR_FEATURES)
    return (
        "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_quantity, 0) AS l_quantity, l_extendedprice, "
        "coalesce(l_discount, 0) AS l_discount, coalesce(l_tax, 0) AS l_tax, l_returnflag, l_linestatus FROM lineitem), "
        "d AS (SELECT *, l_quantity + l_tax AS qty_tax, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS flag_id, "
        "CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS status_code FROM f WHERE l_returnflag IS NOT NULL), "
        "k AS (SELECT * FROM d WHERE status_code IS NOT NULL AND l_extendedprice IS NOT NULL), "
        f"p AS {split_sql(src='k', key=key)}, st AS (SELECT {stats} FROM p WHERE part = 'train') "
        f"SELECT {', '.join(_POS_ORDER)}, part, flag_id, {scaled} FROM p, st")


@register("tabular_prep_rows", _tabular_sql())
def tabular_prep_rows(spark, sf):
    """What the models of ``tabular_prep`` learn from and are judged on."""
    parts, _, _ = _tabular_parts(spark, sf)
    out = standard_scale(parts.where("part = 'train'"), parts, TABULAR_FEATURES, "_z")
    return out.select(*_POS_ORDER, "part", "flag_id", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in TABULAR_FEATURES])


@register("tabular_prep")
def tabular_prep(spark, sf):
    parts, audit, corr = _tabular_parts(spark, sf)
    feats = list(TABULAR_FEATURES)
    ensure_checkpoint_dir(spark)
    scaled = standard_scale(parts.where("part = 'train'"), parts, feats, "_z").withColumn("y", (F.col("flag_id") == 2).cast("double"))
    scaled = scaled.select("part", "y", *[f + "_z" for f in feats]).checkpoint()  # written once for all fits and scores
    train_s, test_s = (assemble(scaled.where(F.col("part") == part), [f + "_z" for f in feats]) for part in ("train", "test"))
    rows = []
    for name, fn in (("logreg", lambda a, b: tabular_logreg(a, b, "y")), ("tree", lambda a, b: decision_tree(a, b, "y")),
                     ("forest", lambda a, b: random_forest(a, b, "y", num_trees=100)),
                     ("boosted", lambda a, b: boosted_trees(a, b, "y"))):
        acc = accuracy_micro(fn(train_s, test_s), "prediction", "y").first()["accuracy"]
        rows.append((name, float(acc), int(audit), float(corr)))
    return spark.createDataFrame(rows, "model string, accuracy double, nulls_before int, max_abs_corr double")


# --- unsupervised corpus ----------------------------------------------------------------

@register("unsupervised_corpus")
def unsupervised_corpus(spark, sf):
    path = FS.scratch_path(spark, "unsup-noheader")
    FS.write_csv(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.col("doc_id").alias("id2"), "text"),
                 path, header=False)
    col5 = FS.read_csv_positional(spark, path, 5, encoding="UTF-8", multi_line=True)
    clean = col5.select(text_normalize(F.col("_c5")).alias("clean"))
    corpus = FS.scratch_path(spark, "unsup-corpus")
    FS.write_text_corpus(clean, "clean", corpus)
    lines = spark.read.text(corpus).withColumnRenamed("value", "text")
    vocab, merges = bpe_train(word_table(lines, "text"), 3000, SPECIALS)
    return vocab.join(merges.select(F.concat("left", "right").alias("token"), "rank"), "token", "left")
