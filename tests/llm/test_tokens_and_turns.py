"""op11, op12 and op13 against brute force."""

import functools
import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventloom.llm import alignment, histogram, queries, turns

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "x▁y", "\t\n", "<|endoftext|> and </s> <0x41>", "🙂 日本 é́", "ab" * 3000, "Same text.", "Same text.", "\0", "ﬁ ½   end ", "﻿mark"]


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i if i != 1 else None, x, 7, "y") for i, x in enumerate(texts)], "doc_id long, text string, row long, block string")


@functools.cache
def _plain_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    with open(BYTES) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    a_bytes = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items() if i != 50256}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    b_bytes = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]}
    return a, a_bytes, b, b_bytes


def _groups(text):
    a, a_bytes, b, b_bytes = _plain_tokenizers()
    if not text:
        return []
    whole = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(a_bytes[i] for i in ids_a) != whole or b"".join(b_bytes[i] for i in ids_b) != whole:
        return []
    ends = []
    for ids, size in ((ids_a, a_bytes), (ids_b, b_bytes)):
        at, out = 0, []
        for i in ids:
            at += len(size[i])
            out.append(at)
        ends.append(out)
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in shared]
    for side, (ids, places) in enumerate(zip((ids_a, ids_b), ends, strict=True)):
        for i, e in zip(ids, places, strict=True):
            groups[next(k for k, s in enumerate(shared) if e <= s) if len(shared) < 50 else __import__("bisect").bisect_left(shared, e)][side].append(i)
    return groups


def _brute_links(texts):
    per_doc, documents_of = [], Counter()
    for text in texts:
        groups = _groups(text)
        pairs = [(x, y) for a, b in groups for x in a for y in b]
        documents_of.update(set(pairs))
        per_doc.append((groups, pairs))
    best = defaultdict(int)
    for (x, _), n in documents_of.items():
        best[x] = max(best[x], n)
    out = []
    for groups, pairs in per_doc:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        counts = [documents_of[p] for p in pairs]
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(pairs),
            sum(n == best[x] for (x, _), n in zip(pairs, counts, strict=True)), sum(counts), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


LINKS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_links_equal_brute_force_on_a_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r[k] for k in LINKS) for r in queries.op11_token_alignment(spark, SF).collect()}
    assert got == dict(zip(texts, _brute_links(list(texts.values())), strict=True))


def test_links_of_odd_texts_over_several_blocks(spark, monkeypatch):
    found = alignment.links(documents(spark, ODD).repartition(3), BYTES, PIECES)
    got = sorted((tuple(r[k] for k in LINKS) for r in found.collect()))
    assert got == sorted(_brute_links(ODD))
    assert found.schema["doc_id"].dataType.simpleString() == "bigint"
    assert alignment.links(documents(spark, []), BYTES, PIECES).count() == 0


def test_overlaps_and_small_products():
    t = alignment.Tokenizers(BYTES, PIECES)
    x = alignment.aligned(["unbelievable tokenizations", None, "Straße"], t)
    for k, text in enumerate(["unbelievable tokenizations", None, "Straße"]):
        a, b = t.ids(text)
        spans = []
        for ids, sizes in ((a, t.a_lengths), (b, t.b_lengths)):
            ends = [int(sum(sizes[j] for j in ids[: i + 1])) for i in range(len(ids))]
            spans.append([(e - int(sizes[i]), e) for i, e in zip(ids, ends, strict=True)])
        assert x.n_overlaps[k] == sum(lo < high and low < hi for lo, hi in spans[0] for low, high in spans[1])


def test_products_in_steps_equal_dense_ones(monkeypatch):
    import numpy as np

    monkeypatch.setattr(alignment, "PRODUCTS", 5)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (9, 7)), rng.integers(0, 3, (7, 11))
    made = [alignment.csr(*(np.repeat(x, m[np.nonzero(m)]) for x in np.nonzero(m)), *m.shape) for m in (a, b)]
    got = np.zeros((9, 11), int)
    for rows, columns, values in alignment.product(*made, 11):
        got[rows, columns] += values
    assert (got == a @ b).all()


def test_whole_numbers_survive_packing():
    import numpy as np

    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, 5], np.int64)
    assert (alignment.unpacked(alignment.packed(values)) == values).all()
    assert len(alignment.unpacked(alignment.packed(values[:0]))) == 0


def _ids(text):
    from tokenizers import Tokenizer

    global _SLOW
    _SLOW = globals().get("_SLOW") or Tokenizer.from_file(BYTES)
    return [*_SLOW.encode(text or "", add_special_tokens=False).ids, 0]


def _check_packs(rows, texts, capacity=1024):
    """Every id in one piece, sequences without gaps and full or of a power of two, checksums and lengths right."""
    ids = {k: _ids(v) for k, v in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[k])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[k][r["start"] : at]))
        assert at == len(ids[k])
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    total = sum(map(len, ids.values()))
    assert sorted(sizes, reverse=True) == [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]


def test_packs_of_a_whole_table_leave_no_padding(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    _check_packs(queries.op12_shortest_pack_first(spark, SF).collect(), texts)


def test_packs_of_odd_texts_and_of_small_capacity(spark):
    texts = dict(enumerate(ODD)) | {k: "word " * k for k in range(20, 60)}
    rows = [(k, v, 1, 2) for k, v in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, rank long")
    for capacity in (8, 1024):
        _check_packs(histogram.packed(docs, BYTES, capacity).collect(), texts, capacity)
    assert histogram.packed(docs.limit(0), BYTES).count() == 0
    twice = histogram.packed(spark.createDataFrame([(1, "a b c")] * 3 + [(None, None)], "doc_id int, text string"), BYTES).collect()
    assert sum(r["length"] for r in twice) == 3 * len(_ids("a b c")) + 1 and twice[0]["doc_tokens"] in (1, len(_ids("a b c")))
    again = [sorted(map(tuple, histogram.packed(docs, BYTES).collect())) for _ in range(2)]
    assert again[0] == again[1]


@pytest.mark.parametrize("seed", range(6))
def test_a_plan_holds_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([4, 16, 64, 1024])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 30, 10**6]) for _ in range(rng.randint(1, 60))}
    found = histogram.plan(counts, capacity)
    held, end = Counter(), defaultdict(list)
    slots = {s: m for m in found.members for s in range(m[3], m[3] + m[4])}
    for slot, low, high, start, size, _, _ in found.parts.tolist():
        member = slots[slot]
        assert member[1] <= low < high <= member[2] and 0 <= start < start + size <= member[0]
        held[int(member[0])] += (high - low) * size
        end[int(member[0]), low].append(start)
    assert held == {k: k * v for k, v in counts.items()}
    total = sum(k * v for k, v in counts.items())
    assert max(int(p[5] + p[2] - p[1]) for p in found.parts) == total // capacity + (total % capacity).bit_count()


def test_a_plan_does_not_grow_with_the_documents():
    rng = random.Random(1)
    sizes = [len(histogram.plan({k: rng.randint(n, 2 * n) for k in range(1, 1025)}).parts) for n in (10**3, 10**8)]
    assert max(sizes) < 50_000


def _brute_repair(rows):
    """Least (cost, audit) by relaxing suffixes over places of the grammar: s, then pairs of u and a."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(len(rows), p): (0, "") if p in (0, 3) else (10**9, "") for p in range(4)}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            for p in range(4):
                cost, audit = best[i + 1, p]
                ways = [(4 + cost, "D" + audit)]
                own, forced, late = rows[i]
                for symbol in "sua":
                    if (p, symbol) in step and not forced and (symbol == own or symbol != "s"):
                        cost, audit = best[i + 1, step[p, symbol]]
                        ways.append(((0 if symbol == own else 3) + 3 * late + cost, ("K" if symbol == own else "R") + audit))
                best[i, p] = min(ways)
        for _ in range(5):
            for (p, symbol), q in step.items():
                if symbol != "s":
                    best[i, p] = min(best[i, p], (3 + best[i, q][0], "I" + best[i, q][1]))
    return best[0, 0]


def _brute_conversation(key, rows):
    """The contract, row by row: rows of (turn, role, text) as they stand in the table."""
    sort = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    found = []
    for turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        found += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    found.sort(key=sort)
    seen, coded, faults = set(), [], Counter()
    for _, role, text in found:
        solid = [c for c in text if c not in " \t\n\v\f\r"]
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = _brute_repair(coded)
    out, i, before = [], 0, ""
    for edit in audit:
        if edit != "D":
            new = "assistant" if before == "u" else "user"
            role = found[i][1] if edit == "K" else new
            out.append(f"{role}:{'' if edit == 'I' else found[i][2]}")
            before = role[:1]
        i += edit != "I"
    held = [t for t, _, _ in found if t is not None]
    gaps = max(held) - min(held) + 1 - len(set(held)) if held else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    return out


def _results(frame):
    return {r["conv_id"]: tuple(r[k] for k in (*turns.NUMBERS, "audit", "repaired_sha256")) for r in frame.collect()}


def test_turns_equal_brute_force_on_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert _results(queries.op13_turn_repair(spark, "/root/testdata/sf0.01")) == {k: _brute_conversation(k, v) for k, v in _by_conversation(table.collect()).items()}


def _made(spark, n, most, seed):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "cut", " ", "", None, "a b.", "\t.", "x" * 50]
    rows = [(k if k else None, rng.choice([None, *range(most)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ünder"]), rng.choice(said)) for k in range(n) for _ in range(rng.randint(1, most))]
    return spark.createDataFrame([(*r, "z", 3) for r in rows], "conv_id long, turn long, role string, text string, copies string, of long"), rows


def test_turns_of_odd_rows_equal_brute_force_on_both_ways(spark):
    frame, rows = _made(spark, 40, 30, 5)
    expected = {k: _brute_conversation(k, v) for k, v in _by_conversation([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows]).items()}
    assert _results(turns.repair(frame)) == expected
    assert _results(turns.repair(frame.repartition(5), large_rows=6)) == expected
    assert _results(turns.repair(frame.limit(0))) == {}


def test_a_large_conversation_takes_many_tasks(spark, monkeypatch):
    rows = [(k, ["user", "assistant"][k % 2 if k % 7 else 0], f"Line {k % 50}." if k % 5 else "same thing.") for k in range(9000)]
    frame = spark.createDataFrame([(1, *r) for r in rows] + [(2, 1, "user", "Hi.")], "conv_id int, turn int, role string, text string")
    frame = frame.withColumn("turn", F.col("turn").cast("long"))
    whole = _results(turns.repair(frame, large_rows=1 << 30))
    assert _results(turns.repair(frame)) == whole
    assert whole[1] == _brute_conversation(1, rows)


@pytest.mark.parametrize("seed", range(4))
def test_alignment_of_rows_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        code = "".join(rng.choice("sua-SUA_xuaua") for _ in range(rng.randint(0, 30)))
        costs = turns.backwards(code, turns.FINAL, True)
        audit, _ = turns.forwards(code, 0, costs, True)
        expected = _brute_repair([(c.lower() if c not in "-_" else "?", c == "x", c in "SUA_") for c in code])
        assert (costs[0][0], audit) == expected, code
