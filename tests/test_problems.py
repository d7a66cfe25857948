import random

from hypothesis import given, settings
from hypothesis import strategies as st

from riacho.operators import error_parse as P

OK = "https://a.example/x;99.881.402/8447-82;Casa S.A.;Ata;Assunto;2020-01-31"


def reasons(spark, *records):
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(records)], "record_id long, raw_record string, reason string")
    return {r.record_id: r.reason for r in P.rejected(df).collect()}


def test_reasons_in_order(spark):
    header = "Link_Download;CNPJ_Companhia;Nome_Companhia;Categoria;Assunto;Data_Referencia"
    got = reasons(
        spark, OK, header, header.lower(), None, "", OK + ";7", OK.replace("Ata", '"A;t""a\nb"'), OK.replace("Ata", 'A"ta'), OK.replace("Ata", '"Ata" (sic)'),
        OK.replace("https", "ftp"), OK.replace("2020-01-31", "31/02/2020"), OK.replace("2020-01-31", " 29/02/2020 "), OK.replace("8447-82", "8447-83"),
        OK.replace("99.881.402/8447-82", "99881402844782"), OK.replace("99.881.402/8447-82", "99881402844782\t"), OK.replace(".example", ""), 'x";' + OK, OK.replace("Casa S.A.", "x" * 200_000),
    )
    assert got == {3: "columns", 4: "columns", 5: "columns", 7: "quoting", 8: "quoting", 9: "value", 10: "value", 12: "value", 15: "value", 16: "quoting"}


def test_sound_records_load_with_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, OK.replace("Ata", '"A ""b"";c"'))], "record_id long, raw_record string")
    row = P.load_index(df).first()
    assert row.categoria == 'A "b";c' and str(row.ref_date) == "2020-01-31"
    assert P.rejected(df.limit(0)).count() == 0 and P.load_index(df.limit(0)).count() == 0


def test_sound_cut_agrees_with_the_parse(spark):
    rng = random.Random(3)
    records = ["".join(rng.choices(['"', '""', ";", "a", "b c", "\n"], k=rng.randint(0, 9))) for _ in range(1500)] + [";;", '"";;""', '"' + ";" * 50_000 + '";a;b', '"' + '""' * 50_000 + '";a;b']
    df = spark.createDataFrame(list(enumerate(records)), "id long, r string")
    for row in P.with_sound_fields(df, "r", ("a", "b", "c")).collect():
        want = P.split_sound(row.r)
        assert row._sound == (want is not None and len(want) == 3)
        assert not row._sound or [row._f0, row._f1, row._f2] == want


def test_plan_is_compiled(spark):
    """No expression of the triage is too large for generated code."""
    df = spark.createDataFrame([(1, OK)], "record_id long, raw_record string")
    plan = P.rejected(df)._jdf.queryExecution().executedPlan()
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
    assert stages.size() >= 1
    for i in range(stages.size()):
        assert stages.apply(i)._3().maxMethodCodeSize() > 0


def brute_cost(record, n, alphabet='";', most=3):
    """Least number of insertions and deletions of quotes and delimiters, by breadth-first search."""
    sound = lambda r: (f := P.split_sound(r)) is not None and len(f) == n
    level = {record}
    for cost in range(most + 1):
        if any(map(sound, level)):
            return cost
        level = {r[:i] + c + r[i:] for r in level for i in range(len(r) + 1) for c in alphabet} | {r[:i] + r[i + 1 :] for r in level for i in range(len(r)) if r[i] in alphabet}
    return None


@settings(max_examples=120, deadline=None)
@given(st.text('a";', max_size=7))
def test_cost_is_least(record):
    cost, edits = P.error_parse(record, 3)
    assert len(edits) == cost
    if (want := brute_cost(record, 3)) is not None:
        # A run of other characters is one step, so it may only be cut at its ends.
        assert cost == want
    assert (P.error_parse(record, 0, quotes_only=True)[0] == 0) == (P.split_sound(record) is not None)


def test_edits_are_stated(spark):
    assert P.error_parse('a;"b', 2)[0] == 1
    assert [what for what, _ in P.error_parse("a", 3)[1]] == ["insert delimiter"] * 2
