import collections
import re
import shutil
import subprocess
import sys

import corpus_pipeline as p
from revguard.llm import decontam_tiling, secret_scan
from revguard.llm import token_rollup as r
from revguard.llm.common import new_folder
from revguard.llm.queries import ORACLE, QUERIES
from revguard.llm.tokens import TextEncoder, word_tokenizer_path
from tests.conftest import SF0001
from tests.llm.helpers import no_docs, odd_docs, odd_rows, words
from tests.llm.test_duplicates import expected_components
from tests.llm.test_quality_secrets import slow_spans, slow_verdicts
from tests.llm.test_tokens_packing import check_packed

CHANGE = "source string, lang string, tokenizer string, before long, after long, n_docs long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_count_once_and_compact(spark):
    store = new_folder(spark, "test-rollup")
    assert r.totals(spark, store).collect() == []
    one = spark.createDataFrame([("a", "en", "v", None, 5, 1), ("a", "en", "v", None, 7, 1), (None, None, "v", None, 3, 1),
                                 ("b", "en", "v", None, 2, 1)], CHANGE)
    two = spark.createDataFrame([("a", "en", "v", 5, 9, 1), ("b", "en", "v", 2, None, 1), ("c", "en", "v", None, None, 1)],
                                CHANGE)
    r.commit(one, store, 1)
    r.commit(two, store, 2)
    expected = sorted([("a", "en", "v", 2, 16), (None, None, "v", 1, 3)], key=repr)
    assert rows_of(r.totals(spark, store)) == expected
    r.commit(one, store, 1)                    # replayed
    r.commit(two.limit(0), store, 3)           # empty
    assert rows_of(r.totals(spark, store)) == expected
    r.compact(spark, store, 1)
    assert rows_of(r.totals(spark, store)) == expected
    r.commit(spark.createDataFrame([("a", "en", "v", 9, None, 1)], CHANGE), store, 4)
    r.compact(spark, store, 4)
    assert rows_of(r.totals(spark, store)) == sorted([("a", "en", "v", 1, 7), (None, None, "v", 1, 3)], key=repr)


def slow_totals(rows):
    """rows: (doc_id, text, lang, source)."""
    out = collections.Counter()
    pieces = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")
    first = {}
    for d, t, _, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, lang, source in rows:
        once = "\n".join(dict.fromkeys((t or "").split("\n")))
        if d is None or d == first[t or ""]:
            for version, n in (("words-1", len(words(once))), ("pieces-1", len(pieces.findall(once)))):
                out[source, lang, version, "docs"] += 1
                out[source, lang, version, "tokens"] += n
    return out


def as_counter(found):
    out = collections.Counter()
    for x in found:
        out[x.source, x.lang, x.tokenizer, "docs"] += x.n_docs
        out[x.source, x.lang, x.tokenizer, "tokens"] += x.n_tokens
    return out


def test_rollup_query(spark):
    rows = [(x.doc_id, x.text, x.lang, x.source) for x in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    assert as_counter(QUERIES["op7_token_rollup"](spark, SF0001).collect()) == slow_totals(rows)


def test_rollup_odd_and_empty(spark):
    for docs, rows in ((odd_docs(spark), odd_rows()), (no_docs(spark), [])):
        store = new_folder(spark, "test-rollup")
        for batch, changes in r.corpus_changes(docs):
            r.commit(changes, store, batch)
        assert as_counter(r.totals(spark, store).collect()) == slow_totals([x[:4] for x in rows])


# --- the pipeline --------------------------------------------------------------------------------

def staged(spark, docs, sf_dir):
    """What each stage returns, each read again from Parquet."""
    out = []
    for name, stage in p.STAGES:
        folder = new_folder(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    kept, unique, clean, masked, packed = staged(spark, docs, SF0001)
    assert all(x.columns == docs.columns for x in (kept, unique, clean, masked))
    rows = docs.collect()
    good = [x for x, e in zip(rows, slow_verdicts([(x.text, x.lang, x.source) for x in rows])) if e["kept"]]
    assert rows_of(kept) == sorted(map(tuple, good), key=repr)
    ids = {c for _, _, c in expected_components([(x.doc_id, x.text) for x in good])}
    assert rows_of(unique) == sorted((tuple(x) for x in good if x.doc_id in ids), key=repr)
    left = [x for x in good if x.doc_id in ids]
    items = [decontam_tiling.words(x.text) for x in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    whole = {x.doc_id for x in left for i in items if i and " ".join(i) in " ".join(decontam_tiling.words(x.text))}
    pure = [x for x in left if x.doc_id not in whole]
    assert rows_of(clean) == sorted(map(tuple, pure), key=repr) and whole
    model = secret_scan.train(secret_scan.labelled_sample(clean))
    expected = []
    for x in pure:
        out, at = "", 0
        for a, _, b in slow_spans(x.text, model)[1]:
            if a >= at:
                out += x.text[at:a] + "[SECRET]"
            at = max(at, b)
        out += x.text[at:]
        expected.append((x.doc_id, out, x.lang, x.source, len(out) if at else x.n_chars))
    assert rows_of(masked) == sorted(expected, key=repr)
    tokenizer = TextEncoder(word_tokenizer_path()).tokenizer
    check_packed(packed.collect(), [x[:2] for x in expected],
                 lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids, 2048)
    assert collections.Counter(x[:5] for x in rows_of(p.run(spark, SF0001))) == collections.Counter(
        x[:5] for x in rows_of(packed))


def test_stages_odd_and_empty(spark):
    docs = odd_docs(spark)
    for out in staged(spark, docs, SF0001)[:-1]:
        assert out.columns == docs.columns
    assert [x.count() for x in staged(spark, no_docs(spark), SF0001)] == [0] * 5


def test_registered(spark):
    import __spark_entry__ as e
    names = list(e.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(ORACLE) <= set(names) and [n for n, _ in p.STAGES][-1] == "packing"


def test_entry_without_the_folder(tmp_path):
    """The entry imports, and has all its other queries, where the text operators have been taken out."""
    import os
    repo = os.path.dirname(os.path.abspath(p.__file__))
    shutil.copytree(f"{repo}/revguard", tmp_path / "revguard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{repo}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), any(x[:2] == 'op' for x in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, left = said.stdout.split()[-2:]
    assert int(n) >= 77 and left == "False"
