import random

from helpers import WORD, docs, prose
from tracelode.llm import passages


def spread(r, words, share):
    return [f"x{r.randrange(10 ** 9)}" if r.random() < share else w for w in words]


def test_planted_passages(spark):
    r = random.Random(5)
    shared = [prose(900 + i, 70).split() for i in range(4)]
    texts, planted = [], {}
    for i in range(120):
        words = prose(i, 150 + r.randrange(200)).split()
        if i % 3:
            at, p = r.randrange(len(words)), shared[i % 4]
            piece = spread(r, p, r.choice([0, 0.03])) if i > 4 else p
            words[at:at] = piece
            planted[i] = (at, at + len(piece), i % 4)
        texts.append(" ".join(words))
    owners = {}
    for i, (_, _, p) in sorted(planted.items()):
        owners.setdefault(p, i)
    found = {}
    for row in passages.shared_passages(docs(spark, texts)).collect():
        found.setdefault(row.doc_id, []).append((row.start, row.end))
        assert row.first_id < row.doc_id and 0 <= row.start < row.end
    later = {i for i in planted if i not in owners.values()}
    exact = {i for i in later if WORD.findall(texts[i])[slice(*planted[i][:2])] == shared[planted[i][2]]}
    assert exact <= set(found) <= later and len(found) >= 0.9 * len(later)
    for i, spans in found.items():
        covered = {w for s, e in spans for w in range(s, e)}
        want = set(range(*planted[i][:2]))
        assert len(covered & want) >= 0.9 * len(want) and len(covered - want) <= 6
    cut = {r.doc_id: r for r in passages.without_shared_passages(docs(spark, texts)).collect()}
    assert set(cut) == set(range(120))
    for i, t in enumerate(texts):
        assert cut[i].n_chars == len(cut[i].text)
        assert (cut[i].text == t) == (i not in found)
        if i in found:
            left = WORD.findall(t)
            for s, e in sorted(found[i], reverse=True):
                del left[s:e]
            assert WORD.findall(cut[i].text) == left


def test_moved_word_and_shift(spark):
    base = prose(1, 90).split()
    other = base[:40] + ["inserted", "words"] + base[40:60] + base[63:]
    rows = passages.shared_passages(docs(spark, [prose(2, 60) + " " + " ".join(base), " ".join(other) + " " + prose(3, 50)])).collect()
    assert [(r.doc_id, r.first_id) for r in rows] == [(1, 0)]
    assert rows[0].start <= 1 and abs(rows[0].end - 89) <= 2


def test_chains_prefer_order():
    at, first = [0, 5, 10, 40, 60, 65], [100, 105, 110, 3, 158, 163]
    import numpy as np

    best = passages.chains(np.array(at), np.array(first))[0]
    assert best == [(0, 15, -100), (60, 70, -98)]


def test_odd_rows(spark):
    long = prose(4, 60)
    texts = [None, "", "few words", long, long, "And " * 3000, "And " * 2500, long + "\n" + long, None, long]
    frame = docs(spark, texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, None, 3]).withColumnRenamed("lang", "seed").withColumnRenamed("source", "words")
    found = passages.shared_passages(frame)
    assert {r.doc_id for r in found.collect()} == {4, 7}
    cut = passages.without_shared_passages(frame)
    assert cut.columns == frame.columns and cut.count() == len(texts)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert left[3] == long and left[4].strip() == "" and WORD.findall(left[7]) == [] and left[2] == "few words"
    assert passages.shared_passages(docs(spark, [])).count() == 0
    assert passages.without_shared_passages(docs(spark, [])).count() == 0


def spans(rows):
    return sorted((r.doc_id, r.start, r.end) for r in rows)


def test_two_passages_in_one_pair(spark):
    one, two = prose(11, 60).split(), prose(12, 60).split()

    def text(i, gap):
        return " ".join(prose(100 + i, 30).split() + one + prose(200 + i, gap).split() + two + prose(300 + i, 30).split())

    # Far apart, near enough for one run, on two diagonals; long passages with a long gap.
    found = passages.shared_passages(docs(spark, [text(0, 100), text(1, 100)])).collect()
    assert spans(found) == [(1, 30, 90), (1, 190, 250)] and {r.identity for r in found} == {1.0}
    assert spans(passages.shared_passages(docs(spark, [text(2, 35), text(3, 35)])).collect()) == [(1, 30, 90), (1, 125, 185)]
    assert spans(passages.shared_passages(docs(spark, [text(4, 100), text(5, 60)])).collect()) == [(1, 30, 90), (1, 150, 210)]


def test_seeds_with_other_first_documents(spark):
    passage = prose(21, 60).split()
    # Every five words of the passage are in an earlier document of their own.
    texts = [" ".join(prose(400 + i, 40).split() + passage[i:i + 5] + prose(500 + i, 40).split()) for i in range(56)]
    texts += [" ".join(prose(600 + i, 30).split() + passage + prose(700 + i, 30).split()) for i in range(2)]
    assert spans(passages.shared_passages(docs(spark, texts)).collect()) == [(57, 30, 90)]
    # Every thirty words are in one as well: no earlier document but the first of two has all of it.
    texts[:56] = [" ".join(prose(400 + i, 40).split() + passage[i:i + 30] + prose(500 + i, 40).split()) for i in range(0, 31, 5)]
    found = spans(passages.shared_passages(docs(spark, texts)).collect())
    assert (7, 30, 90) in found and (8, 30, 90) in found


def test_repeated_lines(spark):
    line = prose(31, 12).split()
    edited = [w for k in range(10) for w in [*line[:5], f"x{k}", *line[6:]]]  # so that no key is shared
    texts = [prose(800, 30).split() + line * 10 + prose(801, 30).split(), prose(802, 25).split() + line * 10 + prose(803, 30).split(),
             prose(804, 20).split() + edited + prose(805, 30).split(), prose(806, 20).split() + line * 25 + prose(807, 30).split()]
    rows = passages.shared_passages(docs(spark, [" ".join(t) for t in texts])).collect()
    assert spans(rows) == [(1, 25, 145), (2, 20, 140), (3, 20, 320)]
    assert {r.first_id for r in rows} == {0}


def test_chains_of_repeated_lines(spark, monkeypatch):
    made, write = {}, passages.cut_lineage

    def counted(frame, label="step"):
        out = write(frame, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(passages, "cut_lineage", counted)
    for repeats in (150, 100, 11):  # of the first document; the others have 110 to 121
        texts = [" ".join([*prose(820, 30).split(), *["Is", "onhe."] * repeats, *prose(821, 30).split()])]
        texts += [" ".join([*prose(830 + i, 20 + i).split(), *["Is", "onhe."] * (110 + i), *prose(850 + i, 30).split()]) for i in range(12)]
        rows = passages.shared_passages(docs(spark, texts)).collect()
        assert spans(rows) == [(i + 1, 20 + i, 240 + 3 * i) for i in range(12)]
        # A few diagonals a document if the first one has about as many; else no word is in more than two runs of 20 words or more.
        assert made["chains"] <= 12 * (4 if repeats > 11 else 2 * 242 // 20), (repeats, made)


def test_repeated_lines_that_differ_alike(spark):
    line = prose(860, 30).split()
    other = [*line[:20], *line[21:26], "x", *line[26:29], "y"]  # 23 of 30 words on the diagonal, 28 with two shifts
    texts = [" ".join([*prose(861, 25).split(), *other * 12]), " ".join([*prose(862, 25).split(), *line * 12])]
    rows = passages.shared_passages(docs(spark, texts)).collect()
    assert len(rows) == 1 and rows[0].doc_id == 1 and rows[0].start <= 30 and rows[0].end >= 375 and rows[0].identity >= passages.IDENTITY


def test_against_a_quadratic_finder(spark):
    r = random.Random(41)
    shared = [prose(900 + i, 55 + 5 * i).split() for i in range(6)]
    line = prose(910, 14).split()
    texts, edited = [], {}
    for i in range(40):
        words = prose(1000 + i, 20).split()
        for k in range(4):
            kind, p = r.randrange(4), r.choice(shared)
            piece = p if kind == 0 else line * r.choice([1, 5, 10]) if kind == 1 else p[(at := r.randrange(30)):at + r.choice([5, 15, 25])]
            if kind == 3 and i > 30:
                piece = [f"x{i}-{k}-{n}" if n % 30 == 22 else w for n, w in enumerate(p)]
                edited[i, k] = (len(words), len(words) + len(piece))
            words += piece + prose(2000 + 10 * i + k, 20 + r.randrange(60)).split()
        texts.append(words)
    found = {}
    for row in passages.shared_passages(docs(spark, [" ".join(t) for t in texts])).collect():
        found.setdefault(row.doc_id, set()).update(range(row.start, row.end))
    runs, pieces, n, m = set(), set(), passages.MIN_WORDS, passages.MIN_CHAIN
    for i, words in enumerate(texts):
        def covered(seen, size):
            return {w for at in range(len(words) - size + 1) if tuple(words[at:at + size]) in seen for w in range(at, at + size)}

        got, near = found.get(i, set()), {w for s, e in (v for (d, _), v in edited.items() if d == i) for w in range(s, e)}
        assert covered(runs, n) <= got, i
        assert len(got & near) >= 0.9 * len(near), i
        assert len(got - near - covered(pieces, m)) <= 0.05 * len(got), i
        runs.update(tuple(words[at:at + n]) for at in range(len(words) - n + 1))
        pieces.update(tuple(words[at:at + m]) for at in range(len(words) - m + 1))
    assert len(found) > 20 and edited
