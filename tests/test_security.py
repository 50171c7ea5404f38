import hashlib
import hmac as py_hmac
import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.functions import netaddr
from tallyfold.functions.hmac import hmac_sha256_hex, hmac_sha256_hex_keycol
from tallyfold.operators import security

GOOD = "1af95ac1739579a889566e9bdddfcd4a5cec55085d7c715538fcddf0b1a6153f"
WRONG = "0ea12a8295fd235412e787b5938b4902ea2187b78069cd5f272125e4944b0c7b"


def test_hmac_vector(spark):
    df = spark.createDataFrame([("test message",)], "m string")
    assert df.select(hmac_sha256_hex("m", "test-key")).first()[0] == GOOD


def test_signature_filter_cases(spark):
    df = spark.createDataFrame(
        [(1, GOOD), (2, WRONG), (3, "invalid-hex-string"), (4, None), (5, ""), (6, GOOD.upper())],
        "i int, h string").withColumn("m", F.lit("test message"))
    st_ = security.signature_status("h", "m", "test-key")
    got = dict(df.select("i", st_.alias("s")).collect())
    assert got == {1: None, 2: 400, 3: 400, 4: None, 5: None, 6: None}
    # no key configured: the check is off
    off = dict(df.select("i", security.signature_status("h", "m", None).alias("s")).collect())
    assert set(off.values()) == {None}


def test_empty_message_and_key(spark):
    df = spark.createDataFrame([("",)], "m string")
    h = df.select(hmac_sha256_hex("m", "")).first()[0]
    assert h == py_hmac.new(b"", b"", hashlib.sha256).hexdigest() and len(h) == 64


@settings(max_examples=25, deadline=None)
@given(msg=st.text(max_size=300), key=st.text(max_size=100))
def test_hmac_matches_python(spark, msg, key):
    df = spark.createDataFrame([(msg, key)], "m string, k string")
    lit_key, col_key = df.select(hmac_sha256_hex("m", key), hmac_sha256_hex_keycol("m", "k")).first()
    want = py_hmac.new(key.encode(), msg.encode(), hashlib.sha256).hexdigest()
    assert lit_key == want and col_key == want


SUBNET_CASES = [
    ("127.0.0.0/8", None, 400), ("127.0.0.0/8", "invalid-ip", 400), ("127.0.0.0/8", "10.0.0.1", 403),
    ("127.0.0.0/8", "127.0.0.1", None), ("fd00::/8", "fd12::1", None), ("fd00::/8", "::1", 403),
    ("127.0.0.0/8", "::ffff:127.0.0.1", None), ("fd00::/8", "127.0.0.1", 403),
    ("127.0.0.0/8", "  127.0.0.1 ", None), ("127.0.0.0/8", "   ", 400), ("fd00::/8", "fd00::1%eth0", 403),
]


@pytest.mark.parametrize("cidr,ip,status", SUBNET_CASES)
def test_subnet_cases(spark, cidr, ip, status):
    df = spark.createDataFrame([(ip,)], "ip string")
    got = security.with_subnet_status(df, "ip", cidr, "s").first()["s"]
    assert got == status


def test_bad_cidr_fails_at_build(spark):
    df = spark.createDataFrame([("1.2.3.4",)], "ip string")
    with pytest.raises(ValueError):
        security.with_subnet_status(df, "ip", "not-a-cidr", "s")


def _v6_text(draw_int, compress):
    a = ipaddress.IPv6Address(draw_int)
    return a.compressed if compress else a.exploded


@settings(max_examples=20, deadline=None)
@given(ints=st.lists(st.integers(0, 2**128 - 1), min_size=1, max_size=20),
       v4=st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=20))
def test_parse_ip_matches_python(spark, ints, v4):
    texts = [_v6_text(i, c) for i in ints for c in (True, False)]
    texts += [str(ipaddress.IPv4Address(i)) for i in v4]
    texts += ["::ffff:" + str(ipaddress.IPv4Address(i)) for i in v4]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (None if r.a is None else (r.a.family, r.a.hex, r.a.zoned))
           for r in netaddr.with_ip(df, "t", "a").collect()}
    for t in texts:
        assert got[t] == netaddr.parse_ip_text(t), t


def test_range_join_matches_ipaddress(spark):
    texts = [f"10.{i % 4}.{i % 256}.{i % 251}" for i in range(200)] + [f"fd00::{i:x}" for i in range(0, 65536, 997)]
    texts += ["fe80::1%eth0", "not-an-ip", "", None, "::ffff:10.1.200.1", " 10.0.0.7 ", "0.0.0.0", "255.255.255.255"]
    cidrs = ["10.0.0.0/16", "10.1.128.0/17", "10.0.0.0/8", "0.0.0.0/0", "10.0.0.7/32", "fd00::/8", "fd00::8000/113", "::/0", "10.0.0.0/13"]
    addrs = spark.createDataFrame(list(enumerate(texts)), "event_id long, ip string")
    table = security.subnet_table(spark, cidrs)
    by_tree, by_join = (sorted((r.event_id, r.cidr) for r in security.addresses_in_subnets(addrs, table, tree_subnets=n).collect()) for n in (64, 3))
    assert by_tree == by_join
    assert by_tree == sorted((r.event_id, r.cidr) for n in (64, 3) for r in security.addresses_in_subnets(addrs, cidrs, tree_subnets=n).collect())[::2]
    got = by_tree
    want = []
    for i, t in enumerate(texts):
        a = netaddr.parse_ip_text(t.strip()) if t else None
        for c in cidrs:
            fam, lo, hi, _ = netaddr.cidr_bounds(c)
            if a and a[0] == fam and not a[2] and lo <= a[1] <= hi:
                want.append((i, c))
    assert got == sorted(want) and got


@settings(max_examples=60, deadline=None)
@given(nets=st.lists(st.tuples(st.sampled_from([4, 6]), st.integers(0, 2**128 - 1), st.integers(0, 128)), max_size=12), data=st.data())
def test_segments_are_disjoint_and_list_their_subnets(nets, data):
    nets = [ipaddress.ip_network((n % 2**(32 if f == 4 else 128), min(b, 32 if f == 4 else 128)), strict=False) for f, n, b in nets]
    rows = [dict(zip(("cidr", "family", "lo", "hi"), (str(n), *netaddr.cidr_bounds(str(n))[:3]))) for n in nets]
    segments = security.address_segments(rows)
    starts = [k for k, _ in segments]
    assert starts == sorted(set(starts)) and segments[-1][1] == []
    inside = [int(n.network_address) + data.draw(st.integers(0, n.num_addresses - 1)) for n in nets]
    for net, number in zip(nets, inside):
        key = f"{net.version}{number:0{8 if net.version == 4 else 32}x}"
        held = [c for k, c in segments if k <= key][-1]
        address = (ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address)(number)
        assert sorted(held) == sorted(str(n) for n in nets if n.version == address.version and address in n)


def test_no_subnets(spark):
    addrs = spark.createDataFrame([(1, "10.0.0.1"), (2, None)], "event_id long, ip string")
    assert security.addresses_in_subnets(addrs, security.subnet_table(spark, ["1.1.1.1/32"]).limit(0)).count() == 0


def test_with_cidr_matches_python(spark):
    cidrs = ["127.0.0.0/8", "10.1.128.0/17", "10.1.130.7/17", "0.0.0.0/0", "1.2.3.4/32",
             "fd00::/8", "2001:db8::/33", "::/0", "::1/128", "fe80::1/10",
             "not-a-cidr", "1.2.3.4/33", "1.2.3.4", "1.2.3.4/08", "::1/129"]
    df = spark.createDataFrame([(c,) for c in cidrs], "c string")
    got = {r.c: (None if r.p is None else (r.p.family, r.p.lo, r.p.hi, r.p.bits))
           for r in netaddr.with_cidr(df, "c", "p").collect()}
    invalid = {"not-a-cidr", "1.2.3.4/33", "1.2.3.4", "1.2.3.4/08", "::1/129"}
    for c in cidrs:
        want = None if c in invalid else netaddr.cidr_bounds(c)
        assert got[c] == want, c


def test_key_tables_are_broadcast(spark):
    """Requests without a key id, and those that share one, stay where they are read: a key table of a size
    that Spark does not know (rows from Python) must not deal the requests out by key id."""
    from tallyfold.operators import envelope
    from tallyfold.plans import catalog
    from tallyfold.sources import requests, tables

    from conftest import SMALL

    def joins(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return "BroadcastHashJoin" in plan, "SortMergeJoin" in plan

    keys = catalog.data_keys(spark)
    reqs = requests.event_json_requests(tables.read_table(spark, SMALL, "events"))
    sent = reqs.withColumn("x_encrypted", F.when(F.col("seq") % 2 == 0, F.lit(envelope.HEADER_VALUE)))
    opened = envelope.open_envelopes(sent, keys)
    assert joins(opened) == (True, False)
    statuses = {(r.seq % 2, r.decrypt_status) for r in opened.select("seq", "decrypt_status").collect()}
    assert statuses == {(0, 400), (1, None)}   # the bodies are no envelopes
    assert joins(requests._on_the_wire(reqs, F.col("request_id"), keys)) == (True, False)
