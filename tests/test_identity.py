import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from eventlift.operators.identity import STRATEGIES, link_identity, match_report, match_stats

GUEST = "guest_id bigint, email string, first_name string, last_name string, status string"
USER = "id bigint, email string, first_name string, last_name string"


def guests(spark, rows):
    return spark.createDataFrame(rows, GUEST)


def users(spark, rows):
    return spark.createDataFrame(rows, USER)


@pytest.fixture(scope="module")
def people(spark):
    g = guests(
        spark,
        [
            (1, " A@x.com ", "Ann", "Lee", "Checked In"),
            (2, "nobody@x.com", " bob ", "RAY", "CHECKED IN"),
            (3, None, "Bob", "Ray", "Registered"),
            (4, "", "Zed", "Zed", "checked in"),
            (5, "a@x.com", "Cy", "Day", None),
            (6, "gone@x.com", "No", "One", " checked in"),
            (7, None, None, None, "checked in"),
        ],
    )
    u = users(
        spark,
        [
            (10, "a@X.com", "Ann", "Lee"),
            (11, "A@x.com", "Other", "Name"),
            (12, "bob@x.com", "Bob", "Ray"),
            (13, "bob2@x.com", "BOB ", "ray"),
            (14, " ", "Blank", "Mail"),
            (15, None, None, None),
        ],
    )
    return g, u


def pairs(df):
    return sorted((r.guest_id, r.user_id or 0) for r in df.collect())


def test_email_fans_out_and_blank_equals_blank(people):
    g, u = people
    linked = link_identity(g, u)
    assert linked.columns == ["user_id", *g.columns]
    assert pairs(linked) == [(1, 10), (1, 11), (2, 0), (3, 0), (4, 14), (5, 10), (5, 11), (6, 0), (7, 0)]
    assert (4, 0) in pairs(link_identity(g, u, blank_as_null=True))


def test_status_is_folded_but_not_trimmed(people):
    g, u = people
    assert pairs(link_identity(g, u, status="checked in")) == [(1, 10), (1, 11), (2, 0), (4, 14), (7, 0)]


def test_one_account_per_key(people):
    g, u = people
    found = pairs(link_identity(g, u, dedupe="min_id"))
    assert found == [(1, 10), (2, 0), (3, 0), (4, 14), (5, 10), (6, 0), (7, 0)]


def test_later_keys_serve_unmatched_guests_only(people):
    g, u = people
    cascade = pairs(link_identity(g, u, "cascade"))
    assert cascade == [
        (1, 10), (1, 11), (2, 12), (2, 13), (3, 12), (3, 13), (4, 14), (5, 10), (5, 11), (6, 0), (7, 0),
    ]
    priority = pairs(link_identity(g, u, "priority"))
    assert priority == [(1, 10), (2, 12), (3, 12), (4, 14), (5, 10), (6, 0), (7, 0)]


def test_only_ascii_spaces_are_trimmed(spark):
    g = guests(spark, [(1, "a@x.com ", "a", "b", "s"), (2, "a@x.com\t", "a", "b", "s")])
    u = users(spark, [(10, "a@x.com", "a", "b")])
    assert pairs(link_identity(g, u)) == [(1, 0), (2, 0)]


def test_stats(people, spark):
    g, u = people
    row = match_stats(link_identity(g, u, status="checked in")).first()
    assert tuple(row) == (5, 3, 2, 60.0)
    empty = match_stats(link_identity(g, u, status="nobody")).first()
    assert tuple(empty) == (0, 0, 0, None)


key = st.sampled_from([None, "", " ", "a", "A ", "b", "c"])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(key, key, key), max_size=12),
    st.lists(st.tuples(st.sampled_from([None, 1, 2, 3, 4, 5]), key, key, key), max_size=12),
)
def test_report_counts_what_the_joins_return(spark, guest_rows, user_rows):
    g = guests(spark, [(i, *r, "s") for i, r in enumerate(guest_rows)])
    u = users(spark, user_rows)
    report = {r.join_strategy: r for r in match_report(g, u).collect()}
    assert list(report) == [s.label for s in STRATEGIES.values()]
    for name, strategy in STRATEGIES.items():
        rows = link_identity(g, u, name).collect()
        got = report[strategy.label]
        matched = sum(r.user_id is not None for r in rows)
        assert (got.total_guests, got.matched) == (len(rows), matched), name
        assert {r.guest_id for r in rows} == set(range(len(guest_rows)))
    assert report[STRATEGIES["priority"].label].total_guests == len(guest_rows)
