import base64
from collections import Counter

import public_tokenizers
import tiktoken

from tidemark.llm import token_counts as tc
from tidemark.llm.bpe import public_vocabulary
from tidemark.llm.common import fresh_path, table


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def test_counts_match_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rollup = tc.TokenRollup(spark, fresh_path(spark, "t"))
    assert rollup.commit("bpe", tc.inserts(tc.bpe_counts(docs, public_vocabulary(spark), "b")))
    assert rollup.commit("words", tc.inserts(tc.word_counts(docs)))
    lines = map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    n, tokens = Counter(), Counter()
    for r in docs.collect():
        for name, count in (("b", len(own.encode_ordinary(r["text"] or ""))), ("words-1", len((r["text"] or "").encode().split()))):
            n[r["source"], r["lang"], name] += 1
            tokens[r["source"], r["lang"], name] += count
    assert totals(rollup) == {k: (n[k], tokens[k]) for k in n}


def test_deltas_and_replays(spark):
    def counts(rows):
        return spark.createDataFrame([(i, s, "en", "t", k) for i, s, k in rows], "doc_id long, source string, lang string, tokenizer string, tokens long")

    first = [(1, "a", 10), (2, "a", 5), (3, "b", 7), (None, None, 2)]
    second = [(1, "a", 12), (3, "a", 7), (4, "b", 1), (None, None, 2)]  # 1 revised, 2 deleted, 3 moved, 4 new
    rollup = tc.TokenRollup(spark, fresh_path(spark, "t"))
    assert totals(rollup) == {}
    assert rollup.commit("1", tc.inserts(counts(first)))
    for _ in range(2):
        rollup.commit("2", tc.revisions(counts(first), counts(second)))
    want = {("a", "en", "t"): (2, 19), ("b", "en", "t"): (1, 1), (None, "en", "t"): (1, 2)}
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want
    assert not rollup.commit("2", tc.revisions(counts(first), counts(second))) and not rollup.commit("1", tc.inserts(counts(first)))
    assert totals(rollup) == want
    rollup.commit("3", tc.deletes(counts([(3, "a", 7), (1, "a", 12)])))
    rollup.compact()
    assert totals(rollup) == {("b", "en", "t"): (1, 1), (None, "en", "t"): (1, 2)}
    assert rollup.commit("4", tc.inserts(counts([]))) and {r["batch_id"] for r in rollup.committed().collect()} == {"1", "2", "3", "4"}


def test_half_written_batch_is_written_anew(spark):
    path = fresh_path(spark, "t")
    rollup = tc.TokenRollup(spark, path)
    row = spark.createDataFrame([("a", "en", "t", 1, 3)], "source string, lang string, tokenizer string, documents long, tokens long")
    tc.deltas(row).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch-x")
    assert totals(rollup) == {}
    assert rollup.commit("x", row) and totals(rollup) == {("a", "en", "t"): (1, 3)}


COUNTS = "doc_id long, source string, lang string, tokenizer string, tokens long"


def test_revisions_of_repeated_and_null_ids(spark):
    """Four documents of 19 tokens become four of 26, whatever their ids."""
    make = lambda rows: spark.createDataFrame([(i, "s", "en", "t", k) for i, k in rows], COUNTS)
    old, new = make([(5, 10), (5, 4), (None, 2), (None, 3)]), make([(5, 11), (5, 9), (None, 6), (None, None)])
    rollup = tc.TokenRollup(spark, fresh_path(spark, "t"))
    rollup.commit("a", tc.inserts(old))
    assert totals(rollup) == {("s", "en", "t"): (4, 19)}
    rollup.commit("b", tc.revisions(old, new))
    assert totals(rollup) == {("s", "en", "t"): (4, 26)}
    rollup.commit("c", tc.revisions(new, make([])))
    assert totals(rollup) == {}


def test_cleaning_keeps_totals_and_identifiers(spark):
    row = spark.createDataFrame([(1, "a", "en", "t", 3)], COUNTS)
    rollup = tc.TokenRollup(spark, fresh_path(spark, "t"))
    for n in range(5):
        rollup.commit(str(n), tc.inserts(row))
        if n % 2:
            rollup.compact()
        rollup.clean()
        assert totals(rollup) == {("a", "en", "t"): (n + 1, 3 * (n + 1))}
    assert not rollup.commit("0", tc.inserts(row)) and not rollup.commit("4", tc.inserts(row))
    assert rollup._named("fold-*") == ["fold-000000001"] and rollup._named("batch-*") == ["batch-4"]


def test_odd_texts_and_empty_tables(spark, make_docs):
    vocabulary = public_vocabulary(spark)
    rows = [(1, None), (1, ""), (None, " \t\n"), (None, "two words"), (3, "very long " * 30_000), (3, "very long " * 30_000)]
    docs = make_docs(rows).withColumnRenamed("kept", "tokens")
    assert sorted(r["tokens"] for r in tc.word_counts(docs).collect()) == [0, 0, 0, 2, 60_000, 60_000]
    assert len(tc.bpe_counts(docs, vocabulary, "b").collect()) == len(rows)
    for counts in (tc.word_counts(make_docs([])), tc.bpe_counts(make_docs([]), vocabulary, "b")):
        rollup = tc.TokenRollup(spark, fresh_path(spark, "t"))
        assert rollup.commit("none", tc.inserts(counts)) and totals(rollup) == {}


def test_query_goes_through_every_kind_of_change(spark):
    """The registered query ends at the totals that a plain count gives."""
    from collections import Counter as C

    from tidemark.llm.queries import op1_token_counts

    sf = "/root/testdata/sf0.001"
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in op1_token_counts(spark, sf).collect()}
    n, words = C(), C()
    for r in table(spark, sf, "documents").collect():
        n[r["source"], r["lang"]] += 1
        words[r["source"], r["lang"]] += len((r["text"] or "").encode().split())
    assert {k[:2]: v for k, v in got.items() if k[2] == "words-1"} == {k: (n[k], words[k]) for k in n}
    assert {k[2] for k in got} == {"words-1", "byte_bpe_50k"} and all(v[0] == n[k[:2]] for k, v in got.items())


def test_batches_committed_during_a_fold_count_once(spark):
    """A batch that comes after the fold has listed the live ones is in neither its list nor its sums."""
    one, more = (spark.createDataFrame([(1, "a", "en", "t", k)] * n, COUNTS) for n, k in ((2, 5), (3, 10)))
    rollup = tc.TokenRollup(spark, fresh_path(spark, "t"))
    rollup.commit("first", tc.inserts(one))
    listed = rollup._live

    def commit_after_listing(covered):
        found = listed(covered)
        if not rollup.is_committed("between"):
            rollup.commit("between", tc.inserts(more))
        return found

    rollup._live = commit_after_listing
    rollup.compact()
    rollup._live = listed
    for _ in range(2):
        assert totals(rollup) == {("a", "en", "t"): (5, 40)}
        assert not rollup.commit("between", tc.inserts(more))
        rollup.compact()
