"""Hand-worked values of the column functions."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from trafficward.functions import address, agent, calendar, common, text


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def test_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(7)
    texts = [
        "::", "::1", "1::", "fe80::1%eth0", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "1::2::3", "12345::", "1:2:3:4:5:6:7",
        "1:2:3:4:5:6:1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "", "abc", "192.0.0.9", "100.64.0.1", "172.32.0.1",
    ]
    for _ in range(100):
        texts.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        wide = ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 16, 64]))
        texts += [str(wide), wide.exploded, str(ipaddress.IPv6Address((0x2001 << 112) | rng.getrandbits(105)))]
    df = spark.createDataFrame([(t,) for t in texts], "ip string").withColumn("ip_type", address.ip_type(F.col("ip")))
    for row in address.add_private(df).collect():
        try:
            known = ipaddress.ip_address(row.ip)
            expected = (f"ipv{known.version}", int(known.is_private))
        except ValueError:
            expected = ("invalid", 0)
        assert (row.ip_type, row.is_private_ip) == expected, row.ip


@pytest.mark.parametrize("ip,letter", [("10.0.0.1", "A"), ("128.1.1.1", "B"), ("192.1.1.1", "C"), ("224.0.0.1", "Other"), ("x", "Unknown"), ("::1", "Unknown")])
def test_network_class(spark, ip, letter):
    assert one(spark, ip).select(address.network_class(F.col("x"))).first()[0] == letter


@pytest.mark.parametrize("value,bits", [(None, 0.0), ("", 0.0), ("aaaa", 0.0), ("abab", 1.0), ("abcd", 2.0)])
def test_entropy(spark, value, bits):
    assert one(spark, value).select(text.entropy(F.col("x"))).first()[0] == pytest.approx(bits)


@pytest.mark.parametrize(
    "url,host",
    [
        (None, "unknown"), ("", "unknown"), ("direct", ""), ("https://www.Google.com/search?q=1", "google.com"),
        ("http://a.b:8080/c", "a.b:8080"), ("//cdn.net/x", "cdn.net"), ("https://user@h.org?x", "user@h.org"),
    ],
)
def test_domain(spark, url, host):
    assert one(spark, url).select(text.domain(F.col("x"))).first()[0] == host


@pytest.mark.parametrize("value,n", [(None, 0), ("", 0), ("  ", 0), ("a", 1), (" a  b\tc ", 3)])
def test_words(spark, value, n):
    assert one(spark, value).select(text.words(F.col("x"))).first()[0] == n


@pytest.mark.parametrize("hour,name", [(0, "night"), (6, "night"), (7, "morning"), (12, "morning"), (13, "afternoon"), (18, "afternoon"), (19, "evening"), (23, "evening")])
def test_segments_are_right_closed(spark, hour, name):
    assert one(spark, hour, "int").select(calendar.segment(F.col("x"))).first()[0] == name


@pytest.mark.parametrize("score,label", [(0.0, None), (0.1, "a"), (3.0, "a"), (3.1, "b"), (5.0, "b"), (10.0, "d"), (10.1, None), (None, None)])
def test_fixed_bins(spark, score, label):
    column = common.right_closed(F.col("x"), [0, 3, 5, 7, 10], ["a", "b", "c", "d"])
    assert one(spark, score, "double").select(column).first()[0] == label


def test_user_agents(spark):
    texts = {
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605 Version/17.1 Mobile Safari/604": ("Mobile Safari", "iOS", "17.1", True, False, False),
        "Mozilla/5.0 (Windows NT 10.0; Win64) AppleWebKit/537 Chrome/120.0 Safari/537 Edg/120.1": ("Edge", "Windows", "10.0", False, False, True),
        "Mozilla/5.0 (Linux; Android 13; SM-X) AppleWebKit/537 Chrome/119.0 Safari/537": ("Chrome Mobile", "Android", "13", False, True, False),
        "Googlebot/2.1": ("Googlebot", "Other", None, False, False, False),
    }
    df = agent.add_parsed_agent(spark.createDataFrame([(t,) for t in texts], "userAgent string"))
    for r in df.collect():
        assert (r.ua_browser_family, r.ua_os_family, r.ua_os_version, r.ua_is_mobile, r.ua_is_tablet, r.ua_is_pc) == texts[r.userAgent]


def test_json_fields_survive_bad_input(spark):
    rows = [("{bad",), (None,), ("",), ('{"os":{"name":"x"}}',)]
    df = text.add_platform(spark.createDataFrame(rows, "platform string"))
    assert [r.os_name for r in df.collect()] == [None, None, None, "x"]
