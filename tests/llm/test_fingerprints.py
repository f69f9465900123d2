import hashlib
import random

import pytest

from tidewright.llm import fingerprints as fp

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def rolled(data, k):
    """The hash of the window that ends at position k, by definition."""
    h = 0
    for i in range(k - fp.WINDOW + 1, k + 1):
        h = (h * int(fp._RADIX) + (data[i] if i >= 0 else 0)) % 2**32
    return (h * int(fp._MIX)) % 2**32 >> 7


def slowly(data, monkey_piece=None):
    """A fingerprint by trying all block sizes from the smallest on."""
    if not data:
        return "4::"
    hashes = [rolled(data, k) for k in range(len(data) - 1)]

    def chunks(bits):
        out, at = [], 0
        for k, h in enumerate(hashes):
            if h % (1 << bits) == (1 << bits) - 1:
                out.append(data[at : k + 1])
                at = k + 1
        return [*out, data[at:]]

    bits = fp.LEAST_BITS
    while len(chunks(bits)) > fp.CHUNKS:
        bits += 1
    said = ["".join(fp._SYMBOLS[(fp.zlib.crc32(c) * 0x9E3779B1 >> 20) % 4096] for c in chunks(b)) for b in (bits, bits + 1)]
    return f"{1 << bits}:{said[0]}:{said[1]}"


@pytest.mark.parametrize("piece", [fp.PIECE, 37])
def test_fingerprints_equal_the_definition(monkeypatch, piece):
    monkeypatch.setattr(fp, "PIECE", piece)
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 8, 40, 300, 1500]:
        for data in (prose(rng, n).encode(), b"a" * n, b"ab" * n, prose(rng, 2).encode() * n):
            assert fp.fingerprint(data) == slowly(data)


def distance(a, b):
    """Insertions and deletions that turn one list into the other."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] if x == y else 1 + min(old[j], row[-1]))
    return row[-1]


def test_common_subsequences_give_the_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice(fp._SYMBOLS[:9]) for _ in range(rng.randrange(64))] for _ in range(2))
        assert len(a) + len(b) - 2 * fp._common("".join(a), "".join(b)) == distance(a, b)


def test_likeness():
    rng = random.Random(3)
    for n in (30, 200, 3000, 20000):
        text, other = prose(rng, n), prose(rng, n)
        own, far = (fp.fingerprint(t.encode()) for t in (text, other))
        assert fp.likeness(own, own) == 1 and fp.likeness(own, far) < 0.15
        moved = fp.fingerprint((text[len(text) // 2 :] + " " + text[: len(text) // 2]).encode())
        changed = fp.fingerprint((text[: len(text) * 2 // 3] + other[: len(text) // 3]).encode())
        assert fp.likeness(own, changed) > 0.4 and fp.likeness(own, moved) > 0.3
        assert fp.likeness(own, changed) == fp.likeness(changed, own)
    assert fp.likeness("4::", "4::") == 1 and fp.likeness("4::", fp.fingerprint(b"abc")) == 0


def expected(rows):
    """The query's rows by definition; rows in order of descending identifiers."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed, following = (slowly(t.encode()) for t in (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, fp.likeness(own, changed), fp.likeness(own, following)))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k * 7 % 101, rng.choice([prose(rng, rng.randrange(90)), "é" * rng.randrange(9), None, ""])) for k in range(101)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, part string, place string").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = fp.op12_fingerprints(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(expected(sorted(rows, key=lambda r: -r[0])))


def test_small_tables_ties_and_nulls(spark):
    def run(rows):
        return sorted(map(tuple, fp.edited_by_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)

    assert run([]) == []
    assert run([(1, "abcdef")]) == expected([(1, "abcdef")])
    same = [(5, "one two three")] * 40 + [(None, "last")]
    got = run(same)
    assert len(got) == 41 and {r[3] for r in got if r[0] == 5} == {fp.fingerprint(b"one two three")} and sum(r[6] == 1 for r in got) == 39
    plain = fp.fingerprints(spark.createDataFrame(same, "doc_id bigint, text string")).collect()
    assert len(plain) == 41 and {r.n_chars for r in plain} == {13, 4}
