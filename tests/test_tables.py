"""Tables of HTML pages: spans, nesting, entities, broken tags; cost records by header."""

from fieldbook.sources import tables as T


def _read(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [(r.page_id, r.block, r.row, r.cells) for r in T.page_tables(df).orderBy("page_id", "block", "row").collect()]


def test_cells(spark):
    got = _read(
        spark,
        "<TABLE class=x><tr><th>A &amp; B<th> c \n d </th></tr><tr><td></td><td> </td></tr><tr><td>1<td>2</table> tail",  # no closing tags; a row without text
        "<table><tr><td rowspan=2>s</td><td>1</td></tr><tr><td>2</td></tr><tr><td colspan='2'>w</td><td>3</td></tr></table>",
        "<table><tr><td>o<table><tr><td>in</td></tr></table>uter</td></tr></table><script>'<table><tr><td>no</td></tr></table>'</script>",
        "<table><tr><td>x<br>y</td><td rowspan=0>down</td><tr><td>z<tr><td>last",  # the page ends inside a cell
        "<table><tr><td>a</td><td>b</td><td rowspan=2>c</td></tr><tr><td>d</td></tr></table>",  # a gap
        "<table><tr><td colspan=zz rowspan=-1>k</td></tr></table><!-- <table><tr><td>no</td></tr></table> -->",
        None, "", "<p>none", "<table></table>",
    )
    assert got == [
        (0, 0, 0, ["A & B", "c d"]), (0, 0, 1, ["1", "2"]),
        (1, 0, 0, ["s", "1"]), (1, 0, 1, ["s", "2"]), (1, 0, 2, ["w", "w", "3"]),
        (2, 0, 0, ["outer"]), (2, 1, 0, ["in"]),
        (3, 0, 0, ["x y", "down"]), (3, 0, 1, ["z", "down"]), (3, 0, 2, ["last", "down"]),
        (4, 0, 0, ["a", "b", "c"]), (4, 0, 1, ["d", "", "c"]),
        (5, 0, 0, ["k"]),
    ]


def test_cost_records(spark):
    roster = "<table><tr><th>Team</th><th>Conference</th><th>2026 Roster Cost</th></tr><tr><td>Aa</td><td>Big</td><td>$1,200</td></tr><tr><td>Bb<td>Big<td>n/a</tr><tr><td>Aa<td>New<td>$1,500</tr><tr><td>short<td>$9</tr></table>"
    spend = "<table><tr><th>School</th><th>Spending Rank</th><th>Div</th><th>Conf</th><th>n</th><th>FY 2025</th></tr><tr><td>Aa<td>1<td>fbs <td>Big<td>3<td>&minus;$2,000</tr><tr><td>Cc<td>2<td>FCS<td>Big<td>3<td>$7</tr></table>"
    other = "<table><tr><th>Team</th><th>Wins</th><th>x</th></tr><tr><td>Aa</td><td>1</td><td>2</td></tr></table>"
    df = spark.createDataFrame([(1, roster), (2, spend), (3, other), (4, None)], "page_id long, html string")
    got = {(r.route, r.team): (r.conference, r.amount, r.page_id) for r in T.cost_records(T.page_tables(df)).collect()}
    assert got == {("roster", "Aa"): ("New", 1500, 1), ("spend", "Aa"): ("Big", -2000, 2)}
    assert T.cost_records(T.page_tables(df.where("page_id > 3"))).count() == 0
