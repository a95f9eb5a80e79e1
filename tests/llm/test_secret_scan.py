import hashlib
import random
import re

from pyspark.sql import functions as F

from caseloom.llm import secret_scan
from caseloom.llm.tables import read

SF = "/root/testdata/sf0.01"


def test_planted_secrets_and_nothing_else(spark):
    docs = read(spark, SF, "documents")
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        planted = re.findall(r'token = "([0-9a-f]{40})"', d.text)
        assert got[d.doc_id].n_secrets == len(planted), d.doc_id
        assert got[d.doc_id].secrets_sha256 == (hashlib.sha256("\n".join(planted).encode()).hexdigest() if planted else "")
        words = [w for line in d.text.split("\n") for w in re.split(r"[ \t\r\f\x0B]+", line)]
        assert got[d.doc_id].n_candidates == sum(bool(re.search(secret_scan.KEY, w)) for w in words)
    assert sum(r.n_candidates for r in got.values()) > 2 * sum(r.n_secrets for r in got.values()) > 0


def test_held_out_findings(spark, documents):
    """The forest tells findings of kinds that the training had, in texts that it had not."""
    rng = random.Random(4)

    def key(chars, n):
        return "".join(rng.choice(chars) for _ in range(n))

    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def texts(n):
        for _ in range(n):
            yield 1, f'the client sets api_key = "{key(hexa, 40)}" here'
            yield 1, f"export AUTH_TOKEN={key(base, 32)} now"
            yield 0, f"see {key('abcdefghij', 20)} for the {key('0123456789', 16)} number"
            yield 0, f"commit {'thisisaverylongname' + key('aeiou', 4)} was merged"
            yield 0, f'set token = "{key(hexa, 32)}" as an example only'

    train, test = list(texts(60)), list(texts(40))
    frames = []
    for rows in (train, test):
        docs = documents([t for _, t in rows])
        scanned, found = secret_scan.candidates(docs, "text", F.lit(""), [F.col("doc_id").alias("id")])
        pieces = secret_scan.dictionary_pieces(docs, "text")
        labels = spark.createDataFrame([(i, float(y)) for i, (y, _) in enumerate(rows)], "id long, label double")
        frames.append(secret_scan.with_features(found.join(scanned.select(secret_scan.ROW, "id"), secret_scan.ROW), pieces).join(labels, "id"))
    forest = secret_scan.train_forest(frames[0])
    right = secret_scan.scored(frames[1], forest).select((F.col("score").__ge__(0.5).cast("double") == F.col("label")).alias("ok")).collect()
    assert sum(r.ok for r in right) >= 0.97 * len(right)


def test_same_forest_again(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    first = sorted(map(tuple, secret_scan.secret_scan(docs).collect()), key=str)
    assert sorted(map(tuple, secret_scan.secret_scan(docs.repartition(5)).collect()), key=str) == first


def test_secrets_are_replaced(spark):
    docs = read(spark, SF, "documents").withColumn("value", F.lit(1))
    clean = secret_scan.without_secrets(docs)
    assert clean.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in clean.collect()}
    assert all(after[i] == re.sub(r'(?<=token = ")[0-9a-f]{40}', "[SECRET]", t) for i, t in before.items())
    assert after != before


def test_native(spark):
    plan = secret_scan.secret_scan(read(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark, odd_documents):
    got = secret_scan.secret_scan(odd_documents).collect()
    assert len(got) == 10 and all(r.n_secrets == 0 and r.secrets_sha256 == "" for r in got)
    assert secret_scan.secret_scan(odd_documents.drop("source").limit(0)).count() == 0
    assert secret_scan.without_secrets(odd_documents).count() == 10


def test_all_runs_of_a_word(spark, documents):
    """Environment lines, minified JSON, addresses and web tokens: the values, all of them, and not their names."""
    one, two = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzK4pQ2sT9v", "fedc0123456789abba9876543210cdef"
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    cases = {
        f"AWS_SECRET_ACCESS_KEY={one}": [one], f"export MY_VERY_LONG_AUTH_TOKEN_2='{two}'": [two], f"AZURE_STORAGE_ACCOUNT_KEY={two}==": [two + "=="],
        f'{{"api_key":"{one}","refresh_token_of_client":"{two}"}}': [one, two],
        f'{{"a":"{two}=","b":"{one}"}}': [two + "=", one],
        f"https://a-very-long-host-label.example.com/?user=1&token={two}&sig={one}": ["//a-very-long-host-label", two, one],
        f"https://{two}:x-oauth-basic@host.org/": ["//" + two],
        f"Authorization: Bearer {jwt}": [jwt], f"token={jwt};": [jwt],
        "SOME_LONG_SETTING_NAME=on": [], "no key at all": [],
    }
    docs = documents(list(cases))
    scanned, found = secret_scan.candidates(docs, "text", F.lit(""), [F.col("doc_id").alias("id")])
    rows = found.join(scanned.select(secret_scan.ROW, "id"), secret_scan.ROW).orderBy("id", "line_no", "word_no", "run_no").collect()
    assert [[r.value for r in rows if r.id == i] for i in range(len(cases))] == list(cases.values())
    named = {(r.id, r.run_no): r.word for r in rows}
    assert named[3, 0] == f'{{"api_key":"{one}' and named[3, 1] == f'","refresh_token_of_client":"{two}"}}'


def test_all_secrets_of_a_word_are_replaced(spark, documents):
    rng = random.Random(11)

    def key(n=40):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    prose = [f"see thisisaverylongname{'aeiou'[i % 5]}word for the {10**15 + i} number" for i in range(60)]
    single = [f'the client sets api_key = "{key()}" here' for _ in range(60)]
    keys = [[key(), key()] for _ in range(20)]
    words = [f'{{"api_key":"{a}","token":"{b}"}}' if i % 2 else f"https://host.org/?api_key={a}&token={b}" for i, (a, b) in enumerate(keys)]
    docs = documents(prose + single + words)
    got = [r.n_secrets for r in secret_scan.secret_scan(docs).orderBy("doc_id").collect()]
    assert got == [0] * 60 + [1] * 60 + [2] * 20
    for r in secret_scan.without_secrets(docs).collect():
        assert not any(k in r.text for pair in keys for k in pair)
