"""Samples stay within their bounds where ids are repeated; the secrets' SQL knows all their rules;
the pipeline on odd tables with columns of any name."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontamination, language, quality_model, quality_rules, secrets, toxicity
from plumbline.llm.tables import bounded_sample

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(n, seed, words="alder birch cedar dogwood elm fir gum hazel iris juniper kapok larch maple nutmeg oak pine".split()):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(words, 30)) for _ in range(n)]


@pytest.fixture(scope="module")
def one_id(spark):
    """Two thousand different texts of one id, and a few others."""
    texts = sentences(2000, 1)
    return spark.createDataFrame([(1 if i < 1990 else i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(texts)], DOC)


@pytest.mark.parametrize("per_label", [300, 1700])
def test_sample_is_that_of_the_smallest_hashes(spark, per_label):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    got = {r.doc_id for r in bounded_sample(rows, "label", per_label).collect()}
    hashes = rows.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).collect()
    for label in (0, 1):
        mine = sorted((r for r in hashes if r.label == label), key=lambda r: r.h)[:per_label]
        assert got >= {r.doc_id for r in mine}
    assert len(got) == 2 * per_label


def test_tasks_cut_their_rows_before_the_shuffle(spark):
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
    plan = bounded_sample(rows, "label", 4000)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in first


def test_repeated_ids_do_not_exceed_the_bound(spark, one_id, monkeypatch):
    sizes = {}
    monkeypatch.setattr(language, "Model", lambda x, names: sizes.update(language=len(names)))
    language.fit(one_id, per_language=40)
    monkeypatch.setattr(toxicity, "prior_of", lambda p, u: 0.1)
    monkeypatch.setattr(toxicity, "Model", lambda p, u, prior: sizes.update(toxicity=(len(p), len(u))))
    toxicity.fit(one_id, one_id.select("doc_id", (F.col("doc_id") == 1).alias("confirmed")), per_class=40)
    monkeypatch.setattr(quality_model, "Model", lambda rows, good, share: sizes.update(quality=len(rows)))
    labels = one_id.select("doc_id", (F.col("doc_id") == 1).cast("int").alias("label"))
    quality_model.fit(one_id, labels, per_class=40)
    monkeypatch.setattr(quality_rules, "learn", lambda x, bad: sizes.update(rules=len(x)))
    quality_rules.fit(one_id, labels, per_class=40)
    assert sizes["language"] <= 80 and sizes["quality"] <= 80 and sizes["rules"] <= 80
    assert sizes["toxicity"][0] <= 40 and sizes["toxicity"][1] <= 160


def test_secrets_sql_knows_key_bodies_and_repositories(spark):
    begin, end = "-----BEGIN EC PRIVATE KEY-----", "-----END EC PRIVATE KEY-----"
    long_body = "\n".join("Ab1+" * 16 for _ in range(6000))
    headed = "\n".join(f"Header-{i}: a-b" for i in range(40)) + "\n" + "Q" * 64
    texts = [
        f"{begin}\n{long_body}\n{end} after",
        f"{begin}\n{long_body}\nprose",
        f"{begin}\n{headed}\n{end}",
        f"x {begin}\\n{'R' * 64}\\nSTU= y {begin}{'T' * 40}{end}",
        f"{begin} {begin}\n{'U' * 64}\n{end}",
        f"{begin} nothing",
        None,
        "",
        *["token ghp_" + "Zy" * 18] * 12,
        "token ghp_" + "Ab" * 18,
        *[f"see {begin}\n{'V' * 64}\n{end}"] * 11,
    ]
    docs = spark.createDataFrame([(i, t, "en", "one", 1) for i, t in enumerate(texts)] + [(None, texts[3], None, None, 1)], DOC)
    got = secrets.digest(secrets.scan(docs)).toPandas()
    documents = docs.toPandas()  # noqa: F841, read by the SQL
    want = duckdb.sql(secrets.SQL).df()
    names = sorted(got.columns)
    rows = [sorted(tuple(str(v) for v in r) for r in t[names].astype(object).where(t[names].notna(), None).itertuples(index=False)) for t in (got, want)]
    assert len(rows[0]) == len(texts) + 1
    for a, b in zip(*rows, strict=True):
        assert [x.removesuffix(".0") for x in a] == [x.removesuffix(".0") for x in b]
    spans = got[got.doc_id == 0].spans.iloc[0]
    assert spans == f"pem:0:{len(texts[0]) - len(' after')}"
    assert got[got.doc_id == 8].n_copied.iloc[0] == 1 and got[got.doc_id == 20].n_live.iloc[0] == 1
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert clean[0] == "[secret] after" and clean[1] == "[secret]\nprose" and clean[2] == "[secret]"


CLASHING = {"_key": "k", "_text": "t", "score": "s", "_id": "i", "_hash": "h", "_spans": "p", "lang_pred": "l", "component_id": "c", "key": "x", "word": "w"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    english, other = sentences(40, 3), sentences(40, 4, "agua boca cielo dedo enero flor gato hoja isla jardín".split())
    passage = " ".join(f"leak{i}" for i in range(14))
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(english)]
    rows += [(100 + i, t, "es", f"s{i % 3}") for i, t in enumerate(other)]
    rows += [
        (200, None, "en", "s"),
        (201, "", None, None),
        (202, " 12 \n\t", "en", "s"),
        (203, english[0] + " copy", "en", "s"),
        (204, f"{english[1][::-1]} {passage} end", "en", "s"),
        (205, f"{english[2][::-1]} token=abcdefgh12", "en", "s"),
        (206, " ".join(f"w{i}" for i in range(200_000)), "en", "s"),
        (207, english[3], "en", "s"),
        (207, english[3], "en", "s"),
    ]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOC)
    docs.select("*", *(F.lit(v).alias(n) for n, v in CLASHING.items())).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("b1", passage), ("b2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_columns_of_any_name(spark, folder, tmp_path):
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    ids = {}
    for name in ("language", "near_duplicates", "decontamination", "secrets"):
        found = stages[name](spark, docs, folder)
        assert found.columns == docs.columns
        found.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        ids[name] = sorted(r.doc_id for r in rows)
        assert all(r[n] == v for r in rows for n, v in CLASHING.items())
    assert set(ids["language"]) == {*range(40), *range(100, 140), 203, 204, 205, 206, 207}
    # a copy goes for the smallest id of its group, as do repeated rows
    assert set(ids["near_duplicates"]) == set(ids["language"]) - {203, 207} and len(ids["near_duplicates"]) == 83
    assert set(ids["decontamination"]) == set(ids["near_duplicates"]) - {204}
    assert ids["secrets"] == ids["decontamination"]
    kept = {r.doc_id: r for r in docs.collect()}
    assert kept[205].text.endswith(" [secret]") and kept[205].n_chars == len(kept[205].text)
    assert len(kept[206].text) > 1_000_000


def test_run_of_odd_and_empty_tables(spark, folder, tmp_path):
    pieces = corpus_pipeline.run(spark, folder)
    per_doc = {r.doc_id: (r.n, r.total) for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()}
    assert len(per_doc) == 82 and all(n == total for n, total in per_doc.values())
    spark.read.parquet(f"{folder}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").filter("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_prior_comes_from_positive_and_unlabelled_rows_alone():
    rng = np.random.default_rng(2)

    def row(bad):
        return np.unique(np.concatenate([rng.integers(0, 400, 40), rng.integers(500, 510, 3) if bad else rng.integers(400, 500, 3)])).astype(np.int32)

    positive = [row(True) for _ in range(300)]
    for share in (0.05, 0.3):
        unlabelled = [row(i < share * 2000) for i in range(2000)]
        assert abs(toxicity.prior_of(positive, unlabelled) - share) < 0.03


def test_risk_of_unlabelled_rows_is_not_let_under_zero():
    """With far too large a prior an uncorrected risk is best where all is positive; the corrected one is not."""
    rng = np.random.default_rng(3)
    positive = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(100)]
    clean = [np.unique(rng.integers(40, 100, 12)).astype(np.int32) for _ in range(300)]
    model = toxicity.Model(positive, clean + positive[:50], 0.4)
    z = np.array([[model.score(r) for r in rows[:100]] for rows in (positive, clean)])
    negative = (z[1].mean() * 300 + z[0].mean() * 50) / 350 - 0.4 * z[0].mean()
    assert negative > -0.05 and (z[1] < 0.5).mean() > 0.8 and (z[0] >= 0.5).mean() > 0.8


def test_one_worker_a_task_tells_contamination(spark):
    """Python steps on end keep a worker each, which the executor holds on to afterwards."""
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([passage, f"a {passage} b", "c d", "", None])], "doc_id long, text string")
    benchmark = spark.createDataFrame([("b1", passage), ("b2", None)], "item_id string, text string")
    found = decontamination.contamination(docs, benchmark)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.runs, r.contaminated) for r in found.collect()) == [
        (0, 12, 12, 1, [0, 12], True),
        (1, 14, 12, 1, [1, 13], True),
        (2, 2, 0, 0, [], False),
        (3, 0, 0, 0, [], False),
        (4, 0, 0, 0, [], False),
    ]
