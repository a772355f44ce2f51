"""The training-data operators against brute force, the public tokenizer library and held-out labels.

Each operator meets nulls, empty and blank texts, ties, repeated rows, a very long text, an empty table and extra
columns with clashing names."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from linkforge.llm import bpe, decontamination, near_dup, pii, quality_cnn, quality_rules, words
from linkforge.llm.bpe_codec import Encoder, code_digests, decode, encode_decode
from linkforge.llm.line_dedup import line_dedup
from linkforge.llm.queries import tokenizer_path
from linkforge.llm.sharding import kd_shards
from linkforge.llm.substring_dedup import substring_dedup
from linkforge.llm.token_counts import Counter, token_counts

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, starts int, copy boolean, runs string, bucket long"


def row(i, text, source="s"):
    return (i, text, None, source, None, "x", 1, None, None, 0)


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "tree", "light", "moon", "river", "stone", "wind", "fire", "glass", "iron"]) + rng.choice(["", "s", "ed", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(6)]
    out = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one two"), row(5, "one two"), row(6, "ONE two three four five")]
    for i, text in enumerate(base):
        out += [row(10 + 10 * i, text), row(11 + 10 * i, text), row(12 + 10 * i, text.replace(text.split()[7], "changed", 1)), row(13 + 10 * i, f"{sentence(rng, 30)} {text[:200]}\n{sentence(rng, 9)}", None)]
    lines = "\n".join(sentence(rng, 5) for _ in range(6))
    out += [row(90, lines), row(91, f"head\n{lines}\n\ntail"), row(92, lines.split("\n")[0] + "\n" + lines), row(93, base[0] + " " + base[1] + " " + sentence(rng, 20_000))]
    out += [row(10, base[0]), row(95, base[2].upper()), row(96, "line a b\nline a b\nline a b\nline a b\nline a b\nline a b")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, row(None, "no id " * 30)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


def test_near_duplicates(docs, rows, empty):
    want, sets = brute_components(rows)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_blocks(docs, rows, monkeypatch):
    """A cluster above the bound is cut into blocks; the result is the same."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 60)
    want, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect() if r.doc_id} == want


def test_band_recall_and_estimate():
    rng, found, errors = np.random.default_rng(0), 0, []
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (240, 40, 40))  # similarity 0.75
        x, y = (near_dup.minima(np.unique(np.concatenate([common, z]))) for z in (a, b))
        found += bool(set(near_dup.band_keys(x)) & set(near_dup.band_keys(y)))
        sig = [np.frombuffer(near_dup.packed(z), np.uint64) for z in (x, y)]
        errors.append(near_dup.estimates(sig[0], sig[1][None])[0] - 0.75)
    assert found == 300 and abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < near_dup.MARGIN


def brute_runs(rows, split, length):
    seen, out = set(), {}
    for i, text in sorted({i: t for i, t, *_ in rows}.items()):
        w = split(text or "")
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            key = tuple(w[a : a + length])
            if key in seen:
                gone[a : a + length] = [True] * length
            seen.add(key)
        out[i] = (w, gone)
    return out


def test_substring_dedup(docs, rows, empty):
    want = brute_runs(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 20)
    got = substring_dedup(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.n_words == 60
            continue
        w, gone = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    assert sum(r.n_removed for r in got) > 400 and substring_dedup(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    want = brute_runs(rows, lambda t: [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")], 3)
    texts = {i: t for i, t, *_ in rows}
    got = line_dedup(docs, F.struct("lang", "source")).collect()
    for r in got:
        if r.doc_id is None:
            continue
        w, gone = want[r.doc_id]
        marks = iter(gone)
        kept = None if texts[r.doc_id] is None else "\n".join(x for x in texts[r.doc_id].split("\n") if not (x.strip(" \t\n\r\x0b\x0c") and next(marks)))
        assert (r.n_lines, r.n_removed, r.text) == (len(w), sum(gone), kept)
    assert {r.doc_id: r.n_removed for r in got}[91] == 6 and line_dedup(empty).count() == 0


def brute_passages(rows, least):
    """Lines in a run of three lines, or of one or two lines of ``least`` words, that also starts earlier."""
    seen, out = set(), {}
    for i, text in sorted({i: t for i, t, *_ in rows}.items()):
        w = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        gone = [False] * len(w)
        for a in range(len(w)):
            for size in (1, 2, 3):
                key = tuple(w[a : a + size])
                if len(key) < size or (size < 3 and sum(len(x.encode().split()) for x in key) < least):
                    continue
                if key in seen:
                    gone[a : a + size] = [True] * size
                seen.add(key)
        out[i] = (w, gone)
    return out


def test_line_dedup_passages(spark, rows, empty):
    """Planted passages of one and two lines go from the second place on, shorter ones stay."""
    rng = random.Random(11)
    one, pair, short = sentence(rng, 25), f"{sentence(rng, 4)}\n{sentence(rng, 18)}", sentence(rng, 9)
    planted = [row(300, f"{one}\nfirst"), row(301, f"second\n\n{one}\n{short}"), row(302, f"{pair}\nthird"), row(303, f"fourth\n{pair}"), row(304, f"{short}\nfifth"), row(305, pair), row(306, pair), row(307, short), row(308, short), row(309, f"{one}\n{one}")]
    everything = [*rows, *planted]
    want = brute_passages(everything, 20)
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame([*everything, row(None, one)], DOCS), passage_words=20).collect()}
    texts = {i: t for i, t, *_ in everything}
    for i, (w, gone) in want.items():
        marks = iter(gone)
        kept = None if texts[i] is None else "\n".join(x for x in texts[i].split("\n") if not (x.strip(" \t\n\r\x0b\x0c") and next(marks)))
        assert (got[i].n_lines, got[i].n_removed, got[i].text) == (len(w), sum(gone), kept), i
    assert {i: got[i].n_removed for i in range(300, 310)} == {300: 0, 301: 1, 302: 0, 303: 2, 304: 0, 305: 2, 306: 2, 307: 0, 308: 0, 309: 2}
    assert got[None].text == one and line_dedup(empty, passage_words=20).count() == 0


@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_windows_find_all_repeats(texts):
    """Equal windows have equal anchors at equal offsets, whatever the texts."""
    from linkforge.llm.repeats import Rule

    rule = Rule(bytes.split, 6, 3)
    r, start, whole, anchor, where = rule.windows([t.encode() for t in texts])
    seen = {}
    for i in range(len(r)):
        key = tuple(texts[r[i]].encode().split()[start[i] : start[i] + 6])
        mark = (whole[i], anchor[i], where[i] - start[i])
        assert seen.setdefault(key, mark) == mark
    assert len(seen) == len(set(whole.tolist()))


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(9)
    texts = {i: t for i, t, *_ in rows}
    items = [(1, " ".join(texts[93].split()[5000:5030])), (2, sentence(rng, 30) + " unseen words here"), (3, "ONE two"), (4, None), (5, ""), (6, " ".join(texts[20].split()[10:19])), (1, " ".join(texts[93].split()[5000:5030]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = set()
    for d, text, *_ in rows:
        for i, item in items:
            a, b = shingles(text), shingles(item)
            if b and 4 * len(a & b) >= 3 * len(b):
                want.add((d, i, len(a & b), len(b)))
    got = decontamination.contained_items(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(got) == len(want) and (93, 1) in {(r.doc_id, r.item_id) for r in got}
    assert decontamination.contained_items(empty, bench).count() == 0 and decontamination.contained_items(docs, bench.limit(0)).count() == 0


def test_decontamination_shuffled(spark, docs, monkeypatch):
    """Beyond the broadcast bound the result is the same."""
    bench = docs.where("doc_id in (10, 20, 30)").selectExpr("doc_id as item_id", "text")
    a = sorted(decontamination.contained_items(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_POSTINGS", 0)
    assert sorted(decontamination.contained_items(docs, bench).collect()) == a and a


def test_sharding(spark, docs, rows, empty):
    got = kd_shards(docs, 6).collect()
    assert len(got) == len(rows) + 1 and {r.law for r in got} == {"bytes"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(6))
    crc = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows} <= crc
    even = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    sizes = {r.shard: r.b for r in kd_shards(even).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(sizes) == 24 and max(sizes.values()) <= 1.02 * min(sizes.values())
    assert kd_shards(empty).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check_ids(library, texts):
    vocab = bpe.vocabulary(tokenizer_path())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(vocab).encode(texts) == want
    assert Counter(vocab).count(texts) == [len(x) for x in want]
    assert [decode(vocab, x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_cases(library):
    check_ids(library, ["", " ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "$" * 301, "aaaa" * 90, "  é́ 日本語 😀\n\n \t x ", "don't I'll 'S", "x\x00\x1f\x85y", "=" * 3000, "a  b  c"])


@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab \n'st0$é日<|endoftext|>", max_size=60)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_bpe_random(library, texts):
    check_ids(library, texts)


def test_bpe_operators(docs, rows, library, empty):
    texts = {i: t or "" for i, t, *_ in rows}
    for r in code_digests(docs, tokenizer_path()).where("doc_id is not null").collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    for r in token_counts(docs, tokenizer_path()).where("doc_id is not null").collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    full = encode_decode(docs, tokenizer_path()).where("doc_id = 20").first()
    assert full.decoded == texts[20] and full.ids == library.encode(texts[20], add_special_tokens=False).ids
    assert code_digests(empty, tokenizer_path()).count() == token_counts(empty, tokenizer_path()).count() == 0


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p for at in where.values() if len(at) > 1 for a in at for p in range(a, a + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, docs, rows, empty):
    texts = {i: t for i, t, *_ in rows}
    junk = [row(200, " | ".join(["home", "about", "news", "mail"] * 9)), row(201, "BUY!! NOW!! " * 3 + "THE!! BEST!! OF!! ALL!! THINGS!! IN!! TOWN!! EVER!!"), row(202, "Ça va bien été là-bas über straße naïve señor niño café, thé vert")]
    texts |= {i: t for i, t, *_ in junk}
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs.unionByName(spark.createDataFrame(junk, DOCS))).collect()}
    for i, text in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(text), i
        assert r.kept <= (not r.base_failed)
    assert not got[201].kept and not got[200].kept and got[202].kept and got[20].kept and got[1].clean_text is None
    assert quality_rules.quality_rules(empty).count() == 0


def test_navigation_marks():
    """Menus and breadcrumbs of any separator fail; quotations in guillemets and letters with the same bytes do not."""
    fails = lambda x: quality_rules.line_fails(x.encode(), len(x.encode().split()))
    assert all(fails(f" {mark} ".join(["Home", "News", "Local", "Mail"])) for mark in ("|", ">", "»"))
    assert fails("» Home » News")
    assert not fails("Home » News") and not fails("Il dit « oui » puis « non » et s'en va") and not fails("Er sagt »ja« und dann »nein« und geht")
    assert not fails("a » b and many more plain words that follow here in one line » so that it is long enough to be plain text again")


def brute_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@given(st.text(alphabet="ab@.+-0123456789 ()\n%é", max_size=80))
@settings(max_examples=400, deadline=None)
def test_pii_base_patterns(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_pii(spark, docs, empty):
    text = "call (555) 010-4477 or +1 (017) 555-7713, mail é bob.x@mail7.example.com 10.2.3.4 300.1.1.1 4111 1111 1111 1111 9807915762804490"
    df = spark.createDataFrame([row(1, text), row(2, None), row(3, "plain words of 1999 and 12 trees"), row(4, text)], DOCS)
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_phone) == (1, 1, 1) and got[1].base == pii.listed(brute_pii(text)) and got[4].spans == got[1].spans
    assert set(got[1].base.split(",")) <= set(got[1].spans.split(",")) and "phone:5:19" in got[1].spans.split(",")
    assert got[2].spans == got[3].spans == "" and pii.find_pii(docs).count() == docs.count() and pii.find_pii(empty).count() == 0


def test_crf_learns_its_table():
    field = pii.trained()
    codes, labels, sizes = pii._examples()
    right = sum(int((pii.viterbi(field.tabled(), field.transition, field.first, c[:n], np.zeros(n, int)) == x[:n]).sum()) for c, x, n in zip(codes, labels, sizes))
    assert right >= 0.97 * sizes.sum()


def test_viterbi_is_exact():
    """Batched decoding against all paths of short lines."""
    rng = np.random.default_rng(1)
    table, trans, first = rng.normal(size=(3, 7, 5)), rng.normal(size=(5, 5)), rng.normal(size=5)
    code, line = rng.integers(0, 7, 9), np.asarray([0, 0, 0, 1, 2, 2, 2, 2, 5])
    got = pii.viterbi(table, trans, first, code, line)
    for k in set(line.tolist()):
        at = np.flatnonzero(line == k)
        score = table[1][code[at]]
        score[1:] += table[0][code[at[:-1]]]
        score[:-1] += table[2][code[at[1:]]]
        best = max(np.ndindex(*(5,) * len(at)), key=lambda p: first[p[0]] + sum(score[i, x] for i, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[at]) == best


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_cnn.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.predicted for r in got if r.quality == 1], [r.predicted for r in got if r.quality == 0]
    assert np.mean(good) >= 0.98 and 1 - np.mean(bad) >= 0.75


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(10, 1, 0), (20, 0, 0), (None, 1, 0), (30, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_cnn.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert quality_cnn.quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_cnn.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_words():
    assert words.slices and [len(s) for s in words.shingle_sets([b"", b"A b", b"a b c d e f", b"a\xc2\x85b c"])] == [0, 1, 2, 1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = {r.doc_id: r.clean_text for r in quality_rules.quality_rules(spark.read.parquet(f"{DATA}/documents.parquet")).where("kept").collect()}
    assert all(not brute_rules(rows[i])[-1] for i in kept)
    runs = brute_runs([(i, t) for i, t in kept.items()], lambda t: [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")], 3)
    lines = {}
    for i, text in kept.items():
        marks = iter(runs[i][1])
        out = "\n".join(x for x in text.split("\n") if not (x.strip(" \t\n\r\x0b\x0c") and next(marks)))
        if out.strip(" \t\n\r\x0b\x0c"):
            lines[i] = out
    comp, _ = brute_components([(i, t) for i, t in lines.items()])
    single = {i: t for i, t in lines.items() if comp[i] == i}
    items = [shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {i: t for i, t in single.items() if not any(b and 4 * len(shingles(t) & b) >= 3 * len(b) for b in items)}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()}


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    """Rows without doc_id pass the stages and are decontaminated too; rows that repeat an id and text become one."""
    import corpus_pipeline

    rng = random.Random(13)
    a, b, c, item = (sentence(rng, 40) for _ in range(4))
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, a, "en", "s", len(a)), (1, a, "de", "s", len(a)), (1, a, "de", "s", len(a)), (2, a, "en", "s", len(a)), (3, b, "en", "s", len(b)), (3, c, "en", "s", len(c)), (None, a, "en", "s", len(a)), (None, a, "en", "s", len(a)), (None, item, "en", "s", len(item)), (4, item, "en", "s", len(item))]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, kinds)
    near = corpus_pipeline.near_stage(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    plain = lambda df: sorted(((r.doc_id, r.text, r.lang) for r in df.collect()), key=repr)
    left = [(1, a, "de"), (3, b, "en"), (3, c, "en"), (None, a, "en"), (None, a, "en")]
    assert plain(near) == sorted([*left, (None, item, "en"), (4, item, "en")], key=repr)
    clean = corpus_pipeline.benchmark_stage(spark, near, str(tmp_path))
    assert clean.columns == docs.columns and plain(clean) == sorted(left, key=repr)
