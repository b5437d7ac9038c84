"""Random strings glued to ordinary words."""

import random
import string

from vecskein.llm import secrets

PREFIXES = ("client_secret_value=", "database_connection_string=", "service_account_private_key_id=", "/v1/customer/order/update/")


def planted(n=60):
    rnd, rows = random.Random(4), []
    for prefix in PREFIXES:
        for size in (20, 24, 32):
            for _ in range(n):
                key = "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(size))
                rows.append((len(rows), f"see {prefix}{key} there", 4 + len(prefix), size))
    return rows


def test_glued_secrets_are_found_and_masked(spark):
    rows = planted()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("markov")] for r in secrets.scan(df).collect()}
    for at in range(0, len(rows), 60):
        part = rows[at : at + 60]
        inside = [sum(max(0, min(e, first + size) - max(s, first)) for s, e in spans[i]) / size for i, _, first, size in part]
        assert sum(x >= 0.7 for x in inside) >= 0.85 * len(part), (part[0], sum(x >= 0.7 for x in inside))
    for r in secrets.redact(df).collect():
        want, text = rows[r.doc_id][1], rows[r.doc_id][1]
        for s, e in reversed(spans[r.doc_id]):
            want = want[:s] + "[SECRET]" + want[e:]
        assert r.text == want, text


def test_two_in_one_candidate(spark):
    text = "client_key=aZ3kQ9xW7pLm2VbN8tRcX4/customer_database_connection_string_handler_service_order_update=Qw8Zk3Vx9Bn5Jm2Lp7Rt"
    found = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    masked = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert found.n_markov == 2 and "customer_database" in masked and masked.count("[SECRET]") == 2


def test_ordinary_names_stay(spark):
    rnd, words = random.Random(6), secrets._WORDS.split()
    names = ["_".join(rnd.choice(words) for _ in range(5)) + str(rnd.randrange(10000)) for _ in range(500)]
    names += ["/v1/" + "/".join(rnd.choice(words) for _ in range(5)) for _ in range(500)]
    got = secrets.scan(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")).collect()
    assert sum(r.n_markov for r in got) == 0
