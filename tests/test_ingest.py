import pytest

from eventlift.operators import identity
from eventlift.sources import ingest
from eventlift.sources.workspace import Workspace, shared_folder


def test_headers():
    assert ingest.clean_header(" First Name ") == "first_name"
    assert ingest.clean_header("E-Mail (work)") == "e_mail_work"
    assert ingest.clean_header("Ticket No.") == "ticket_no" and ingest.clean_header("ÄB_1%/c") == "äb_1_c"


def test_empty_headers_are_numbered(spark):
    assert ingest.clean_headers(spark.createDataFrame([(1, 2)], "`%` int, `a` int")).columns == ["column_1", "a"]


def test_dotted_headers_pass_through(spark):
    guests = spark.createDataFrame([("A@x ", "n", "m", "checked in", 7)], "email string, first_name string, last_name string, status string, `ticket.no.` int")
    users = spark.createDataFrame([(5, "a@X", "N", "M")], "id bigint, email string, first_name string, last_name string")
    linked = identity.link_identity(guests, users, "cascade")
    assert linked.columns[-1] == "ticket.no." and linked.first()[0] == 5
    assert ingest.sample(linked, 1, ["ticket.no."]).first()[-1] == 7
    assert identity.match_report(guests, users).count() == 5
    with pytest.raises(ValueError, match="user_id"):
        identity.link_identity(guests.withColumnRenamed("status", "User_ID"), users)


def test_verified_ingest_into_a_catalog_table(spark, workspace):
    path = f"{workspace.root}/verified"
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "`Guest No.` int, `Name` string")
    rows.write.option("header", True).csv(path)
    done = ingest.ingest_verified(spark, path, "verified_guests", ["guest_no"], schema=rows.schema, sample_rows=1)
    try:
        assert sorted(map(tuple, spark.table("verified_guests").collect())) == [(1, "a"), (2, "b")]
        assert tuple(done.profile.first()) == (2, 2, "Guest No., Name")
        assert [tuple(r) for r in done.sample.collect()] == [(1, "a")]
    finally:
        spark.sql("DROP TABLE verified_guests")


def test_headers_may_not_clash(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `A-b` int")
    with pytest.raises(ValueError, match="a_b"):
        ingest.clean_headers(df)


@pytest.mark.parametrize("format", ["csv", "json", "parquet"])
def test_file_to_table(spark, workspace, format):
    rows = [(1, " x ", 'say "hi", you'), (2, None, "line"), (3, "y", None)]
    df = spark.createDataFrame(rows, "`Guest ID` int, `First-Name` string, `Notes` string")
    path = f"{workspace.root}/in-{format}"
    writer = df.write.format(format)
    if format == "csv":
        writer = writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.save(path)
    schema = df.schema if format == "json" else None
    table = ingest.ingest(spark, path, f"{workspace.root}/table-{format}", format, schema=schema)
    assert table.columns == ["guest_id", "first_name", "notes"]
    assert sorted(tuple(r) for r in table.collect()) == rows
    assert ingest.row_count(table).first().row_count == 3
    assert tuple(ingest.profile(table).first()) == (3, 3, "guest_id, first_name, notes")
    assert [r.guest_id for r in ingest.sample(table, 2, ["guest_id"]).collect()] == [1, 2]


def test_catalog_table(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("a_view")
    assert ingest.read_table(spark, "a_view").count() == 1


def test_overwrite_and_append(spark, workspace):
    path = f"{workspace.root}/modes"
    df = spark.range(3)
    ingest.write_table(df, path)
    ingest.write_table(df, path)
    assert ingest.read_table(spark, path).count() == 3
    ingest.write_table(df, path, mode="append")
    assert ingest.read_table(spark, path).count() == 6


def test_header_report(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "`Guest ID` int, `First-Name` string")
    assert [tuple(r) for r in ingest.header_report(df).collect()] == [
        (1, "Guest ID", "guest_id", 2), (2, "First-Name", "first_name", 1),
    ]


def test_workspace_uses_the_shared_folder(spark):
    assert Workspace(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_two_studies_keep_their_views_apart(spark):
    one, two = Workspace(spark, views="one_"), Workspace(spark, views="two_")
    one.create_or_replace(spark.range(1), "t")
    two.create_or_replace(spark.range(2), "t")
    assert spark.table("one_t").count() == 1 and spark.table("two_t").count() == 2


def test_a_run_leaves_nothing_behind(spark, tmp_path):
    with Workspace(spark, str(tmp_path)) as workspace:
        assert workspace.stage(spark.range(3), "t").count() == 3
    assert list(tmp_path.iterdir()) == []


def test_steps_are_views(spark, workspace):
    table = workspace.create_or_replace(spark.range(4), "four_rows")
    workspace.create_or_replace(spark.range(5), "four_rows")
    assert table.count() == 4 and spark.table("four_rows").count() == 5


def test_line_break_inside_quotes(spark, tmp_path):
    path = tmp_path / "guests.csv"
    path.write_text('Guest ID,Note\n1,"two\nlines"\n2,plain\n')
    table = ingest.ingest(spark, str(path), str(tmp_path / "table"), multiLine=True)
    assert sorted(tuple(r) for r in table.collect()) == [(1, "two\nlines"), (2, "plain")]


def test_drop_deletes_only_this_run(spark):
    kept, dropped = Workspace(spark), Workspace(spark)
    table = kept.stage(spark.range(2), "t")
    dropped.stage(spark.range(2), "t")
    dropped.drop()
    assert table.count() == 2
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.parquet(f"{dropped.root}/000-t").count()


@pytest.fixture(params=["path", "catalog"])
def loaded(request, spark, tmp_path):
    """A target that a first load has filled, and a file that a second load chokes on."""
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("Guest ID,Name\n1,a\n2,b\n")
    bad.write_text("Guest ID,Name\n3,c\nx,d\n")
    target = str(tmp_path / "table") if request.param == "path" else "replaced_guests"
    options = {"schema": "`Guest ID` int, `Name` string", "mode": "overwrite"}
    ingest.ingest(spark, str(good), target, **options)
    yield target, str(good), str(bad), options
    if request.param == "catalog":
        spark.sql(f"DROP TABLE {target}")


def rows_of(spark, target):
    return sorted(map(tuple, ingest.read_table(spark, target).collect()), key=repr)


def left_behind(tmp_path):
    return [p.name for p in tmp_path.iterdir() if ingest.ASIDE in p.name or ingest.BEFORE in p.name]


def test_a_load_that_cannot_read_leaves_the_old_table(spark, loaded, tmp_path, monkeypatch):
    target, _, bad, options = loaded
    real = ingest.read_file
    monkeypatch.setattr(ingest, "read_file", lambda s, *a: real(s, *a, **{"mode": "FAILFAST"}))
    with pytest.raises(Exception, match="(?i)malformed|failed"):
        ingest.ingest(spark, bad, target, schema=options["schema"])
    assert rows_of(spark, target) == [(1, "a"), (2, "b")]
    assert left_behind(tmp_path) == []


def test_a_load_that_does_not_verify_leaves_the_old_table(spark, loaded, tmp_path, monkeypatch):
    target, good, bad, options = loaded
    real = ingest.stored_rows
    monkeypatch.setattr(ingest, "stored_rows", lambda s, p: real(s, p) - 1)
    with pytest.raises(ValueError, match="rows were written"):
        ingest.ingest(spark, bad, target, **options)
    assert rows_of(spark, target) == [(1, "a"), (2, "b")] and left_behind(tmp_path) == []
    monkeypatch.setattr(ingest, "stored_rows", real)
    ingest.ingest(spark, good, target, **options)
    ingest.ingest(spark, bad, target, **options)
    assert rows_of(spark, target) == [(3, "c"), (None, "d")]
    assert left_behind(tmp_path) == []


def test_a_table_may_change_its_columns(spark, loaded, tmp_path):
    target, *_ = loaded
    other = tmp_path / "other.csv"
    other.write_text("No\n7\n")
    ingest.ingest(spark, str(other), target, schema="No int")
    assert rows_of(spark, target) == [(7,)]


def test_a_swap_that_was_killed_is_taken_back(spark, tmp_path):
    target = tmp_path / "table"
    ingest.replace_table(spark.range(3), str(target))
    target.rename(tmp_path / f"table{ingest.BEFORE}1")
    with pytest.raises(ZeroDivisionError):
        ingest.replace_table(_Failing(spark.range(4)), str(target))
    assert rows_of(spark, str(target)) == [(0,), (1,), (2,)]
    assert left_behind(tmp_path) == []


class _Failing:
    """A table whose rows cannot be read."""

    def __init__(self, df):
        self.sparkSession = df.sparkSession

    def observe(self, *_):
        raise ZeroDivisionError
