import base64
import hashlib
import random
import re
import string
import time
import uuid

import pyarrow.parquet as pq
import pytest

from helpers import docs, prose
from tracelode.llm import secret_scan as ss

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def encoding():
    return ss._encoding(open(ss.default_vocabulary(), "rb").read())


def base_spans(text):
    """By the definition: match, then drop."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def random_spans(text, encode):
    """Every run of the alphabet, cut by hand, judged by the ratio of its tokens."""
    text, out, at = text or "", [], 0
    alphabet = set(string.ascii_letters + string.digits + "+/_=-")
    base = base_spans(text)
    while at < len(text):
        end = at
        while end < len(text) and text[end] in alphabet:
            end += 1
        run = text[at:end]
        if len(run) >= 20 and not any(a <= at and end <= b for a, _, b in base) and not ss.is_known(run):
            tokens = sum(len(encode(run[i:i + 512])) for i in range(0, len(run), 512))
            if len(run) < 1.9 * tokens:
                out.append((at, 3, end))
        at = max(end, at + 1)
    return out


def brute(doc_id, text, encode):
    base = base_spans(text)

    def named(spans):
        return ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in spans)

    return (doc_id, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(named(base).encode()).hexdigest(), named(sorted(base + random_spans(text, encode))))


def rows(frame):
    return sorted((tuple(r)[:6] for r in ss.secret_report(frame).collect()), key=repr)


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    encode = encoding().encode_ordinary
    want = [brute(r["doc_id"], r["text"], encode) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    assert rows(spark.read.parquet(path)) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 5


def test_odd_rows(spark):
    assert ss.secret_report(docs(spark, [])).count() == 0
    r, encode = random.Random(2), encoding().encode_ordinary
    key = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = [None, "", "🙂é token = abcdefgh1", "token=token=abcdefgh", "password: \"token\" : abcdefghijk", "TOKEN:'short", "toKen = abcdefghijk", "paſſword=abcdefghi",
             "AKIAAKIAABCDEFGHIJK AKIA AKIAABC", "AKIA" * 9, "f" * 31 + " " + "f" * 32 + "g" + "0" * 64, f"é {key} and {key}", f"secret={key}", key * 3000, "token " * 20_000, "a" * 200_000,
             f"api_key = {key}\nApiKey={key}\npasswd:{key}", f"token={'x' * 8}/{key} {key}", "token" + " " * 50_000 + "x"]
    ids = [None, 1, 1, *range(3, len(texts))]
    frame = docs(spark, texts, ids=ids).withColumnRenamed("lang", "secrets").withColumnRenamed("n_chars", "spans")
    assert rows(frame) == sorted((brute(i, t, encode) for i, t in zip(ids, texts)), key=repr)
    assert ss.find_secrets(frame).columns == ["doc_id", "source", "spans", "secrets"]


def test_random_strings_are_found_and_names_are_not():
    r, coder = random.Random(9), encoding()

    def flagged(run):
        return ss.spans_of(f"see {run} here", {"random"}, coder, ss.CHARACTERS_A_TOKEN) == [(4, 4 + len(run), "random")]

    alphabets = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"]
    made = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (20, 24, 32, 44, 88) for _ in range(40)]
    assert sum(map(flagged, made)) >= 0.97 * len(made)
    data = [r.randbytes(64) for _ in range(50)]
    known = [getattr(hashlib, kind)(d).hexdigest() for d in data for kind in ("md5", "sha1", "sha256", "sha512")]
    known += [k.upper() for k in known] + [str(uuid.UUID(bytes=d[:16])) for d in data] + ["sha512-" + base64.b64encode(d).decode() for d in data]
    known += ["getUserAccountByEmailAddress", "spark_sql_shuffle_partitions_number", "/usr/local/lib/python3/site-packages/", "org/apache/spark/sql/catalyst/expressions",
              "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement", "=" * 60, "-" * 60, "2024-01-31-2024-02-29-17", "4" * 30, "MAX_PARTITION_BYTES_DEFAULT_V2", "HTTPServerErrorHandlerFactory2"]
    assert [k for k in known if flagged(k)] == []


def test_few_spans_in_prose():
    coder = encoding()
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).to_pylist()]
    assert sum(bool(ss.spans_of(t or "", {"random"}, coder, ss.CHARACTERS_A_TOKEN)) for t in texts) <= len(texts) // 1000


@pytest.mark.parametrize("run", ["abcdefghijklmnopqrstuvwxyz" * 400 + "X_x", "aB" * 5000, "a1" * 5000, "Aa1_" * 5000, "-" * 20_000 + "a"])
def test_hard_runs_take_linear_time(run):
    began = time.time()
    ss.is_known(run)
    ss.characters_a_token(run, encoding())
    assert time.time() - began < 2
