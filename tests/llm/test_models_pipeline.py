import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.samples import SCHEMA, WORDS, ordered, prose, rows
from tests.llm.test_dedup import expected_near
from tests.llm.test_lines_urls import expected_lines
from tidewright.llm import decontaminate, toxicity
from tidewright.llm.queries import QUERIES, not_held_out

LABELS = "doc_id bigint, quality int, toxic int"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
INSULTS = ["moron", "idiot", "scum", "filth"]


def remarks(n, seed):
    """Documents of which one in four has insults, and what each is."""
    rng, texts, toxic = random.Random(seed), [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 60)).split()
        toxic.append(int(i % 4 == 0))
        for _ in range(rng.randint(3, 8) if toxic[-1] else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        texts.append(" ".join(words))
    return texts, toxic


def test_toxicity_on_held_out_documents(spark):
    texts, toxic = remarks(800, 3)
    docs = spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate(texts)] + rows()[:3], SCHEMA)
    labels = spark.createDataFrame([*[(i, 1, t) for i, t in enumerate(toxic)], (None, 1, 1), (5, 1, None), (9999, 1, 1)], LABELS)
    model = toxicity.fit(docs, not_held_out(labels))
    held = docs.join(labels, "doc_id").filter("doc_id < 800 and toxic is not null").exceptAll(
        docs.join(not_held_out(labels), "doc_id")
    )
    got = toxicity.score(held, model).select("toxic", "score").collect()
    assert len(got) > 100
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in got) >= 0.95 * len(got)
    odd = [(1, None), (2, ""), (3, " \n"), (4, "moron " * 100_000), (4, "moron " * 100_000), (None, "ka")]
    odd = spark.createDataFrame(odd, "doc_id bigint, text string").withColumn("score", F.lit("old"))
    scores = [r.score for r in toxicity.score(odd, model).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert scores[0] == scores[1] == scores[2] < 0.5 and scores[3] == scores[4]
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame(rows()[:20], SCHEMA)
    for some, labels in ((docs, [(0, 1, 1), (3, 1, 1)]), (docs, []), (docs.limit(0), [(0, 1, 1), (3, 1, 0)])):
        model = toxicity.fit(some, spark.createDataFrame(labels, LABELS))
        assert toxicity.score(docs, model).filter("score between 0 and 1").count() == 20


def test_toxicity_counts_every_word_of_the_corpus(spark, monkeypatch):
    texts = [r[1] for r in rows()] + [None, "", "Ka ka KA lo. ka", "Ka ka KA lo. ka"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    expected = defaultdict(int)
    for text in texts:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for _, word in set(zip(["", *words], words)):
            expected[word] += 1
    expected = {int(toxicity.word_hashes(w)[0]): n for w, n in expected.items()}
    for at_a_time in (50, 10**6):
        monkeypatch.setattr(toxicity, "COUNTED_WORDS", at_a_time)
        assert {r.word: r.n for r in toxicity._corpus_counts(docs).collect()} == expected
    assert toxicity._corpus_counts(docs.limit(0)).count() == 0


def substituted(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"zz{at}"
    return words


def expected_quotes(table, items, masks=decontaminate.MASKS, window=13, min_equal=10):
    """Every alignment in which a mask's words are equal, compared word by word."""
    out = set()
    for doc, text in {(r[0], r[1]) for r in table if r[0] is not None}:
        d = re.split(r"[^\w]+|_", (text or "").lower())
        for item, item_text in set(items):
            if item is None:
                continue
            b = [w for w in re.split(r"[^\w]+|_", (item_text or "").lower()) if w]
            for shift in range(-len(b), len(d) + 1):
                same = {j for j in range(len(b)) if 0 <= j + shift < len(d) and b[j] == d[j + shift]}
                if not any(
                    all(at + p in same for p, bit in enumerate(m) if bit == "1")
                    for m in masks
                    for at in range(len(b) - len(m) + 1)
                ):
                    continue
                low, high, w = max(0, -shift), min(len(b), len(d) - shift), min(window, len(b))
                best = max((len(same & set(range(s, s + w))) for s in range(low, high - w + 1)), default=0)
                if best * window >= w * min_equal:
                    out.add((doc, item))
    return out


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_benchmark_against_brute_force(spark, broadcast_rows):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([4, 12, 20, 40]))) for i in range(12)]
    items += [(3, items[3][1]), (3, prose(rng, 15)), (None, items[5][1]), (50, None), (51, ""), (52, " .. ")]
    table = rows(2)
    for i, (_, text) in enumerate(items[:12]):
        words = text.split()
        quoted = " ".join(substituted(words, min(len(words) // 7, 3), rng))
        table.append((500 + i, f"{prose(rng, 30)} {quoted} {prose(rng, 10)}", *[None] * 7))
        table.append((600 + i, quoted.upper().replace(" ", ", "), *[None] * 7))
    docs = spark.createDataFrame(table, SCHEMA)
    benchmark = spark.createDataFrame([(*i, "x", 7) for i in items], "item_id bigint, text string, doc string, version int")
    found = decontaminate.contaminated(docs, benchmark, broadcast_rows=broadcast_rows).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected_quotes(table, items)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found}) > 12
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_long_document_beyond_the_broadcast(spark):
    """Rows do not grow with the text where the seeds are not sent around."""
    rng = random.Random(8)
    item = prose(rng, 40)
    words = [f"w{rng.randrange(50_000)}" for _ in range(20_000)]
    docs = spark.createDataFrame(
        [(1, " ".join(words[:9000] + item.split() + words[9000:])), (2, " ".join(words))], "doc_id bigint, text string"
    )
    benchmark = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    found = decontaminate.contaminated(docs, benchmark, broadcast_rows=0).collect()
    assert [(r.doc_id, r.item_id, r.n_equal) for r in found] == [(1, 7, 13)]


def quotes_of_the_rule(table, items, window=13, min_equal=10):
    """Pairs with an alignment of enough equal words, whatever finds it."""
    out = set()
    for doc, text in table:
        d = text.split()
        for item, item_text in items:
            b = item_text.split()
            w = min(window, len(b))
            for shift in range(-len(b), len(d) + 1):
                same = [0 <= j + shift < len(d) and b[j] == d[j + shift] for j in range(len(b))]
                low, high = max(0, -shift), min(len(b), len(d) - shift)
                if any(same) and any(sum(same[s : s + w]) * window >= w * min_equal for s in range(low, high - w + 1)):
                    out.add((doc, item))
    return out


def test_every_placement_of_the_allowed_changes_is_found(spark):
    rng = random.Random(5)
    items = [(n, " ".join(f"{rng.choice(WORDS)}{n}x{i}" for i in range(n))) for n in range(1, 14)]
    table = []
    for n, text in items:
        for changes in range(n * 3 // 13 + 2):
            for places in itertools.combinations(range(n), changes):
                words = [f"zz{i}" if i in places else w for i, w in enumerate(text.split())]
                table.append((len(table), f"before {' '.join(words)} after"))
    assert len(table) > 1000
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    wanted = quotes_of_the_rule(table, items)
    assert {(r.doc_id, r.item_id) for r in found} == wanted
    assert sum(item == 13 for _, item in wanted) == 1 + 13 + 78 + 286


def test_other_rules_have_their_masks(spark):
    docs = spark.createDataFrame([(1, "a b x d e y g h"), (2, "a x c y e z g h")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, "a b c d e f g h")], "item_id bigint, text string")
    found = decontaminate.contaminated(docs, benchmark, masks=(), window=8, min_equal=6).collect()
    assert [(r.doc_id, r.n_equal) for r in found] == [(1, 6)]
    with pytest.raises(ValueError):
        decontaminate.contaminated(docs, benchmark, min_equal=0)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    import pandas as pd

    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(4)
    texts, toxic = remarks(400, 8)
    quoted = [prose(rng, 30) for _ in range(3)]
    table = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    table += [(1000 + r[0], *r[1:5]) for r in rows() if r[0] is not None and r[0] < 180]
    table += [(2000 + i, f"{prose(rng, 20)} {q} {prose(rng, 20)}", "en", "web", 0) for i, q in enumerate(quoted)]
    copied = [w for w in prose(rng, 120).split() if w]
    table += [(3000 + i, " ".join(substituted(copied, i % 2, rng)), "en", "web", 0) for i in range(6)]
    table += [(4000, None, None, None, None), (4001, "", "en", "web", 0), (None, "no id here", "en", None, 10)]
    for name, data, columns in (
        ("documents", table, ["doc_id", "text", "lang", "source", "n_chars"]),
        ("labels", [(i, 1, t) for i, t in enumerate(toxic)], ["doc_id", "quality", "toxic"]),
        ("benchmark", list(enumerate(quoted)), ["item_id", "text"]),
    ):
        frame = pd.DataFrame(data, columns=columns)
        whole = [c for c in columns if c in ("doc_id", "item_id", "n_chars")]
        frame.astype({c: "Int64" for c in whole}).to_parquet(f"{folder}/{name}.parquet", index=False)
    return str(folder), table, toxic, quoted


@pytest.fixture
def one_partition(spark):
    """Small tables need no parallel shuffles; most of the pipeline's time here would go into starting their tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pipeline_against_its_stages_by_brute_force(spark, corpus, one_partition):
    folder, table, toxic, quoted = corpus
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"]
    docs, kept = spark.createDataFrame(table, DOCUMENTS), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), DOCUMENTS).coalesce(1)
        kept.append([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    clean, lines_once, alone, unquoted = kept
    gone = {r[0] for r in table} - {r[0] for r in clean}
    assert sum(i in gone for i, t in enumerate(toxic) if t) >= 0.95 * sum(toxic)
    assert not [i for i in gone if i is None or i >= 400 or not toxic[i]]

    wanted = [r[:2] for r in expected_lines(clean) if not r[3] or re.search(r"[^\x20\x09-\x0D]", r[1])]
    lost = {(r[0], r[1]) for r in expected_lines(clean) if r[3]}
    assert ordered((r[0], r[1] or "") for r in lines_once) == ordered(wanted)
    assert all(r[4] == len(r[1]) for r in lines_once if (r[0], r[1]) in lost)

    stay = {r[0] for r in expected_near(lines_once, 80) if r[3]}
    assert ordered(alone) == ordered(r for r in lines_once if r[0] in stay)
    assert sum(r[0] is not None and 3000 <= r[0] < 3006 for r in alone) == 1

    quotes = {doc for doc, _ in expected_quotes(alone, list(enumerate(quoted)))}
    assert {2000, 2001, 2002} <= quotes
    assert ordered(unquoted) == ordered(r for r in alone if r[0] not in quotes)

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in unquoted}
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_all_dealt_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
    assert len(set(WORDS)) == len(WORDS)
