"""What holds for all operators: any id, any column name, empty and repeated rows, the session as it was."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockloom.llm import bpe, common, decontam, exact_dedup, quality, secrets, simhash, substring, suffix_dedup, token_store, url_filter

from .cases import frame, odd_documents

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
NAMES = ("__id", "__sha", "__gone", "__low", "__k", "__t", "__url", "row", "Row", "late", "text_sha256", "found", "piece", "id", "__scratch")
TOP = (1 << 63) - 1


def clashing(spark, rows):
    """The rows with columns of all names that the operators might use, none of which may change."""
    own = frame(spark, rows).select("doc_id", "text")
    for i, n in enumerate(NAMES):
        if n.lower() not in {c.lower() for c in own.columns}:
            own = own.withColumn(n, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return own


def untouched(rows, columns):
    return all(r[c].split(":", 1)[1] == ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for c in columns if c not in ("doc_id", "text"))


@pytest.mark.parametrize("blocks", [1, 3])
def test_columns_with_clashing_names(spark, monkeypatch, blocks):
    rows = odd_documents()
    docs = clashing(spark, rows)
    items = spark.createDataFrame([(1, next(t for _, t, *_ in rows if t and len(t) > 300)[:200], "x")], "item_id long, text string, row string")
    if blocks > 1:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", 80)
    for out in (exact_dedup.keep_first(docs), quality.keep_good(docs), simhash.drop_near_duplicates(docs), decontam.remove(docs, items)):
        got = out.collect()
        assert out.columns == docs.columns and got and untouched(got, docs.columns)


def test_ids_of_any_size_come_back(spark):
    text = "one two three four five six seven eight nine ten"
    ids = [TOP, TOP - 1, TOP - (1 << 40), -TOP - 1, 0, None]
    docs = frame(spark, [(i, text if n % 2 else f"{text} {n}", "en", f"s{n}", None, None, "c", None, 1) for n, i in enumerate(ids)])
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    path = token_store.new_path(spark)
    token_store.write(docs, path, WORDS, 1)
    outs = [exact_dedup.dedup(docs), simhash.simhash_groups(docs), substring.remove_repeats(docs), suffix_dedup.remove_copies(docs), bpe.round_trip(docs, BYTES), decontam.scan(docs, items), quality.classify(docs), secrets.scan(docs), token_store.digests(spark, path)]
    for out in outs:
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(ids, key=str)
    keep = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup(docs).collect()}
    assert keep[TOP - 1] == (-TOP - 1, False) and keep[None] == (-TOP - 1, False) and keep[-TOP - 1] == (-TOP - 1, True)
    got = token_store.tokens(spark, path, [TOP, -TOP - 1])
    assert set(got) == {TOP, -TOP - 1}


def test_the_session_stays_as_it_was(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before, tables = [spark.conf.get(k, None) for k in keys], len(spark.catalog.listTables())
    docs = frame(spark)
    exact_dedup.dedup(docs).count()
    substring.remove_repeats(docs).count()
    bpe.round_trip(docs, BYTES).count()
    assert [spark.conf.get(k, None) for k in keys] == before and len(spark.catalog.listTables()) == tables


def test_scratch_must_be_shared():
    class Nothing:
        def isDefined(self):  # noqa: N802
            return False

    class Fake:
        master, applicationId = "spark://host:7077", "app"
        sparkContext = property(lambda self: self)
        conf = property(lambda self: self)
        _jsc = property(lambda self: self)

        def getConf(self):  # noqa: N802
            return self

        def get(self, key, default=None):
            return default

        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return Nothing()

    with pytest.raises(RuntimeError):
        common.scratch_root(Fake())


TM = "abbabaabbaababba"


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_unlike_words_get_their_own_tokens(spark, n):
    word = TM
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    t = Tokenizer.from_file(WORDS)
    memory = token_store.WordMemory(WORDS)
    texts = [word, other, f"{other} {word}", word + ".", other + "."]
    for _ in range(2):
        for text in texts:
            raw = text.encode()
            flat, count = memory.encode(common.np.frombuffer(raw, common.np.uint8), common.spans_of(common.np.array([len(raw)])))
            assert flat.tolist() == t.encode(text, add_special_tokens=False).ids and count.tolist() == [len(flat)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_store_with_either_tokenizer(spark, path):
    texts = ["Hello World, THE end", "Ünïcode  \n two", "", None, "x" * 30 + " ELEVENLETTERS elevenletters ElevenLetters", "it's 2024 <|endoftext|> DON'T", "İİ K   nbsp　wide"]
    store = token_store.new_path(spark)
    token_store.write(frame(spark, [(i, t, "en", "s", None, None, "c", None, 1) for i, t in enumerate(texts)]), store, path, 1)
    t = Tokenizer.from_file(path)
    got = token_store.tokens(spark, store, list(range(len(texts))))
    assert {i: x.tolist() for i, x in got.items()} == {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}


def test_random_access_reads_few_blocks(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(200)), "en", "s", None, None, "c", None, 1) for i in range(400)] + [(None, "no id", "en", "s", None, None, "c", None, 1)]
    path = token_store.new_path(spark)
    token_store.write(frame(spark, rows), path, WORDS, 1, block_tokens=1000)
    every = token_store.read(spark, path).count()
    some = token_store.holding(spark, path, [7, 311])
    assert every > 60 and some.count() == 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "least" in plan.split("PushedFilters")[1].split("\n")[0]
    assert set(token_store.tokens(spark, path, [7, 311, 9999])) == {7, 311}


def test_weighted_terms_from_a_file(spark, tmp_path):
    rnd = random.Random(2)
    terms = sorted({"".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 9))) for _ in range(20000)})
    weights = {t: rnd.choice([0.25, 0.5, 1.0]) for t in terms}
    (tmp_path / "terms.tsv").write_text("".join(f"{t}\t{w}\n" for t, w in weights.items()))
    urls = ["http://h.net/" + "/".join(rnd.sample(terms, rnd.randint(0, 4))) for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, rules=(), terms=url_filter.read_terms(spark, str(tmp_path / "terms.tsv"))).collect()
    for r in got:
        words = set(urls[r["page_id"]].split("//h.net/")[1].split("/")) - {""}
        strict = sum(weights[w] >= 1 for w in words)
        soft = [weights[w] for w in words if weights[w] < 1]
        assert (r["n_strict"], r["n_soft"], r["verdict"]) == (strict, len(soft), "block" if strict or sum(soft) >= 1 else "allow")
    assert {r["verdict"] for r in got} == {"block", "allow"}
    long = spark.createDataFrame([(1, "http://a.net/" + "x" * 3_000_000 + "/casino")], "page_id long, url string")
    assert url_filter.judge(long).first()["verdict"] == "block"


def test_a_value_in_many_repositories_is_an_example(spark):
    value = "Zx9" * 9
    rows = [(i, f"{value} here", lang, "one", None, None, "c", None, 1) for i, lang in enumerate(["en", "de", "fr", "es", "it"])]
    assert sum(r["n_owned"] for r in secrets.scan(frame(spark, rows)).collect()) == 0
    assert sum(r["n_owned"] for r in secrets.scan(frame(spark, rows[:3])).collect()) == 3
    assert sum(r["n_owned"] for r in secrets.scan(frame(spark, rows), max_repos=5).collect()) == 5


def test_places_of_very_many_matches(spark):
    text = "é " + "token=abcdef " * 20000
    r = secrets.scan(frame(spark, [(1, text, "en", "s", None, None, "c", None, 1)])).first()
    spans = r["spans"].split(",")
    assert r["n_assign"] == 20000 and spans[0] == "assign:2:14" and spans[-1] == f"assign:{2 + 13 * 19999}:{2 + 13 * 19999 + 12}"


@pytest.mark.parametrize("rows", [[], None])
def test_pipeline_of_empty_and_of_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline

    docs = clashing(spark, odd_documents() if rows is None else rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r["decoded"] for r in out}) == len(out) and (len(out) > 20 if rows is None else not out)
