"""Small typed-in inputs for operators, with what they give, as SQL values."""

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import versions as V
from folio.operators import filters, joins, ordering, reports

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_METRICS = "# HELP g_seconds A summary.\n# TYPE g_seconds summary\ng_seconds{quantile=\"0\"} 0.5\ng_seconds_sum 4.25\n# HELP go Number.\n# TYPE go gauge\ngo 9\n\nk{partition=\"9\",topic=\"a\",topic=\"b\"} 2.7e+07\n"


_TABLE = "=" * 80 + "\nAvailable\n" + "=" * 80 + "\n Vendor | Use | Version | Dist | Status | Identifier\n" + "-" * 80 + "\n Gluon         |     | 22.1 | gln     |            | 22.1-gln  \n               |     | 22.0 | gln     |            | 22.0-gln  \n Zulu          |     | 21.0 | zulu    |            | 21.0-zulu \n" + "=" * 80 + "\nOmit"


_ADOC = "= Title\nJo <jo@x.org>\n:a: 1\n\nSome *bold* and `code`, see <<_second>>.\n\n== Second\n\n* one\n** two\n\n[source,java]\n----\nint a = 1;\n----\n\nifdef::a[]\nNOTE: kept {a}\nendif::[]\n\n|===\n|h1 |h2\n\n|c1 |c2\n|===\n"


_DRAWING = "+----+\n| ab |\n+----+\nno box"


@query("SELECT * FROM (VALUES ('#fff', '#000'), ('#000000', '#fff'), ('#336', '#fff'), ('#abcdef', '#000'), ('#ff0000', '#fff')) t(colour, contrast)")
def fn_text_colour(spark, d):
    at = spark.createDataFrame([("#fff",), ("#000000",), ("#336",), ("#abcdef",), ("#ff0000",)], "colour string")
    return at.select("colour", T.text_colour(F.col("colour")).alias("contrast"))


@query("SELECT * FROM (VALUES (1, 'features', 'module,extension,capability', 0), (2, 'install', '', 1)) t(id, terms, synonyms, x)")
def fn_query_terms(spark, d):
    at = spark.createDataFrame([(1, "What are the features?", 0), (2, "How to install this project", 1)], "id int, q string, x int")
    primary, synonyms = T.query_terms(F.col("q"))
    return at.select("id", F.array_join(primary, ",").alias("terms"), F.array_join(synonyms, ",").alias("synonyms"), "x")


@query("SELECT * FROM (VALUES (0, '0'), (61000, '1mn 1s 1ms'), (3600000, '1h 60ms')) t(millis, shown)")
def fn_human_duration(spark, d):
    at = spark.createDataFrame([(0,), (61000,), (3600000,)], "millis int")
    return at.select("millis", T.human_duration(F.col("millis")).alias("shown"))


@query("SELECT * FROM (VALUES ('Jo <jo@x.org>, Al <al@x.org>', 'Jo;Al', 'jo@x.org;al@x.org'), ('Sole', 'Sole', '')) t(line, names, mails)")
def fn_authors(spark, d):
    at = spark.createDataFrame([("Jo <jo@x.org>, Al <al@x.org>",), ("Sole",)], "line string")
    a = T.authors(F.col("line"))
    return at.select("line", F.array_join(F.transform(a, lambda x: x["name"]), ";").alias("names"), F.array_join(F.transform(a, lambda x: x["mail"]), ";").alias("mails"))


@query("SELECT * FROM (VALUES ('foo(); <1>' || chr(10) || 'bar <2>', 'foo(); (1)' || chr(10) || 'bar (2)', '1,2')) t(code, shown, numbers)")
def fn_callouts(spark, d):
    at = spark.createDataFrame([("foo(); <1>\nbar <2>",)], "code string")
    shown, numbers = T.callouts(F.col("code"))
    return at.select("code", shown.alias("shown"), F.array_join(numbers.cast("array<string>"), ",").alias("numbers"))


@query("SELECT * FROM (VALUES ('Home', '/', FALSE), ('Foo', 'foo.html', FALSE), ('Page 1', NULL, TRUE)) t(label, href, active)")
def fn_breadcrumb(spark, d):
    from folio.functions import markup

    at = spark.createDataFrame([("Home[/] > Foo[foo.html] > Page 1",)], "b string")
    return at.select(F.explode(markup.breadcrumb_items(F.col("b"))).alias("x")).select("x.*")


@query("SELECT * FROM (VALUES ('<ul>' || chr(10) || '<li><strong>a</strong></li>' || chr(10) || '</ul>' || chr(10) || '<h2>T &amp; x</h2>' || chr(10) || '<p><code>c</code></p>')) t(html)")
def fn_markdown(spark, d):
    from folio.functions import markup

    return spark.createDataFrame([("- **a**\n\n## T & x\n`c`",)], "m string").select(markup.markdown(F.col("m")).alias("html"))


@query("SELECT p FROM (VALUES ('/valid.html'), ('/a/index.html')) t(p)")
def flt_embeddable(spark, d):
    pages = spark.createDataFrame([("/index.html",), ("/404.html",), ("/page-2.html",), ("/valid.html",), ("/a/index.html",)], "p string")
    sources = spark.createDataFrame([("/a/index.adoc",)], "s string")
    known = pages.join(sources, F.regexp_replace("p", r"\.html$", ".adoc") == F.col("s"), "left")
    return known.where(filters.embeddable(F.col("p"), F.col("s").isNotNull())).select("p")


@query("SELECT * FROM (VALUES (1, 'star'), (2, 'gift')) t(post, icon)")
def jn_first_icon(spark, d):
    posts = spark.createDataFrame([(1, 0, "plain"), (1, 1, "Top News"), (1, 2, "release"), (2, 0, "release"), (3, 0, "none")], "post int, pos int, category string")
    icons = spark.createDataFrame([("top-news", "star"), ("release", "gift")], "category string, icon string")
    return joins.first_icon(posts, icons, "post", "pos", "category", lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-")))


@query("SELECT * FROM (VALUES (1, 1), (3, 1), (3, 2)) t(point, shape)")
def jn_inside(spark, d):
    points = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 9, 9), (0, 3, 3, 3)], "drawing int, point int, x int, y int")
    box = lambda a, b: [{"x": a, "y": a}, {"x": b, "y": a}, {"x": b, "y": b}, {"x": a, "y": b}]
    shapes = spark.createDataFrame([(0, 1, box(0, 5)), (0, 2, box(2, 4))], "drawing int, shape int, polygon array<struct<x:int,y:int>>")
    return joins.inside(points, shapes, "x", "y", "polygon").select("point", "shape")


@query("SELECT * FROM (VALUES (1, '1.2'), (2, '1.2.3'), (3, '1.10.0'), (4, '2.0')) t(rank, folder)")
def ord_folders(spark, d):
    at = spark.createDataFrame([("1.10.0",), ("2.0",), ("1.2",), ("1.2.3",)], "folder string")
    return ordering.numbered(at.withColumn("k", V.folder_key(F.col("folder"))), "k").select(F.col("rank").cast("int"), "folder")


@query("SELECT * FROM (VALUES (1, 'v1.2', '1.2'), (2, 'v1.2.0', '1.2.0'), (3, 'v1.10.1', '1.10.1'), (4, 'latest', 'latest')) t(rank, tag, version)")
def ord_tags(spark, d):
    at = spark.createDataFrame([("v1.10.1",), ("latest",), ("v1.2.0",), ("v1.2",)], "tag string")
    ranked = ordering.numbered(at.withColumn("k", V.tag_key(F.col("tag"))), "k")
    return ranked.select(F.col("rank").cast("int"), "tag", V.version_of_tag(F.col("tag"), "v${version}").alias("version"))


@query("SELECT * FROM (VALUES (1, '8.0.302'), (2, '11.0.9'), (3, '11.0.10'), (4, '17.0.1-tem'), (5, '17.0.2')) t(rank, version)")
def ord_tools(spark, d):
    at = spark.createDataFrame([("17.0.2",), ("11.0.10",), ("8.0.302",), ("11.0.9",), ("17.0.1-tem",)], "version string")
    return ordering.numbered(at.withColumn("k", V.tool_key(F.col("version"))), "k").select(F.col("rank").cast("int"), "version")


@query("SELECT * FROM (VALUES ('central', 0), ('github', 1), ('zulu', 2), ('sdkman', 3)) t(provider, rank)")
def ord_providers(spark, d):
    at = spark.createDataFrame([("sdkman",), ("zulu",), ("central",), ("github",)], "provider string")
    first = F.when(F.col("provider") == "central", 0).when(F.col("provider") == "sdkman", 2).otherwise(1)
    return ordering.numbered(at.withColumn("o", first), "o", "provider").select("provider", (F.col("rank") - 1).cast("int").alias("rank"))


@query("SELECT * FROM (VALUES ('b' || chr(10) || 'd', 'a' || chr(10) || 'c' || chr(10) || 'd')) t(tagged, without)")
def set_tagged_lines(spark, d):
    at = spark.createDataFrame([("a\n# tag::x[]\nb\n# end::x[]\nc\n# tag::y[]\nd\n# end::y[]",)], "t string")
    return at.select(T.tagged_lines(F.col("t"), "*").alias("tagged"), T.tagged_lines(F.col("t"), "**,!x").alias("without"))


@query("SELECT * FROM (VALUES ('=== T' || chr(10) || 'x', '  a' || chr(10) || '    b', '1', '2024-01-01', 'first')) t(deeper, indented, number, date, remark)")
def fn_document_lines(spark, d):
    at = spark.createDataFrame([("= T\nx", " a\n   b", "v1, 2024-01-01: first")], "t string, c string, r string")
    r = T.revision(F.col("r"))
    return at.select(T.level_offset(F.col("t"), 2).alias("deeper"), T.indented(F.col("c"), 2).alias("indented"), r["number"].alias("number"), r["date"].alias("date"), r["remark"].alias("remark"))


@query("SELECT * FROM (VALUES ('category-others', 'io_x_Root', 3, 'Fixes' || chr(10) || '** one', 1.0)) t(class, anchor, next, body, length)")
def fn_small(spark, d):
    at = spark.createDataFrame([("others,simple", "#/schemas/io.x.Root", '<select data-version-iteration="2">', "Release 1.0 Fixes\n* one", [3.0, 4.0])], "c string, r string, h string, b string, v array<double>")
    unit = T.unit_vector(F.col("v"))
    return at.select(T.category_class(F.col("c")).alias("class"), T.schema_anchor(F.col("r")).alias("anchor"), T.next_version(F.col("h")).alias("next"), T.release_body(F.col("b"), F.lit("1.0")).alias("body"), F.round(F.sqrt(F.aggregate(unit.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)), 5).alias("length"))


@query("SELECT * FROM (VALUES ('hug un known!', '1,5,6,4,4,2')) t(text, ids)")
def fn_wordpiece(spark, d):
    from folio.functions import wordpiece

    vocabulary = {"[PAD]": 0, "[CLS]": 1, "[SEP]": 2, "h": 3, "[UNK]": 4, "hug": 5, "un": 6, "##known": 8}
    vocabulary["kn"] = 7
    at = spark.createDataFrame([("hug un known!",)], "text string")
    ids = wordpiece.encoded(F.col("text"), vocabulary)
    return at.select("text", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("SELECT * FROM (VALUES ('<body><!-- VERSIONS START --><select><option value=\"1.10\">1.10</option><option value=\"1.2\" selected>1.2</option></select><!-- VERSIONS END --></body>')) t(html)")
def fn_version_select(spark, d):
    from folio.functions import markup, versions

    select = markup.version_select(spark.createDataFrame([("1.2",), ("1.10",)], "folder string"), versions.folder_key(F.col("folder")), "1.2")
    page = spark.createDataFrame([("<body></body>",)], "html string").crossJoin(select)
    once = page.withColumn("html", markup.with_select(F.col("html"), F.col("select"), "<body>"))
    return once.select(markup.with_select(F.col("html"), F.col("select"), "<body>").alias("html"))


@query("SELECT * FROM (VALUES ('document', 1), ('section', 1), ('listing', 1), ('admonition', 1), ('ulist', 2), ('item', 2), ('table', 1), ('row', 2), ('cell', 4), ('bold', 1), ('code', 1), ('anchor', 1)) t(kind, n)")
def doc_node_counts(spark, d):
    from folio.functions import asciidoc

    tree = asciidoc.nodes(spark.createDataFrame([(1, _ADOC)], "id int, text string"), "id", "text")
    return tree.where(~F.col("kind").isin("text", "paragraph", "attribute", "set-attribute")).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("SELECT '_second' AS target, 'Second' AS label")
def doc_cross_references(spark, d):
    from folio.functions import asciidoc

    tree = asciidoc.nodes(spark.createDataFrame([(1, _ADOC)], "id int, text string"), "id", "text")
    return asciidoc.cross_references(tree, "id").select("target", "label")


@query("SELECT * FROM (VALUES ('Root', 'a', 'string', NULL), ('Root', 'b', 'object', 'B'), ('Root', 'c', 'array', 'B'), ('B', 'x', 'integer', NULL)) t(parent, name, kind, target)")
def doc_schema_properties(spark, d):
    from folio.operators import schemas

    body = '{"title":"Root","properties":{"a":{"type":"string"},"b":{"$ref":"#/definitions/B"},"c":{"type":"array","items":{"$ref":"#/definitions/B"}}},"definitions":{"B":{"properties":{"x":{"type":"integer"}}}}}'
    return schemas.properties(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").select("parent", "name", "kind", "target").distinct()


@query("SELECT * FROM (VALUES (1, 2, 'ab'), (3, 0, 'no box')) t(y, x, text)")
def arr_text_runs(spark, d):
    from folio.functions import markup

    return markup.text_runs(markup.cells(spark.createDataFrame([(1, _DRAWING)], "id int, t string"), "id", "t"), "id").select("y", "x", "text")


@query("SELECT * FROM (VALUES (0, '0 0,5 0,5 2,0 2')) t(shape, corners)")
def arr_shapes(spark, d):
    from folio.functions import markup

    at = markup.shapes(spark.createDataFrame([(1, _DRAWING)], "id int, t string"), "id", "t")
    return at.select("shape", F.array_join(F.transform("polygon", lambda p: F.concat_ws(" ", p["x"], p["y"])), ",").alias("corners"))


@query("""SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0"><channel><title>T</title><link>http://s</link><lastBuildDate>Tue, 2 Jan 2024 00:00:00 GMT</lastBuildDate>' || chr(10) || '<item><title>B</title><link>http://s/b.html</link><pubDate>Tue, 2 Jan 2024 00:00:00 GMT</pubDate><description></description></item>' || chr(10) || '<item><title>A &#x26; a</title><link>http://s/a.html</link><pubDate>Mon, 1 Jan 2024 00:00:00 GMT</pubDate><description>x</description></item>' || chr(10) || '</channel></rss>' AS value""")
def snk_rss(spark, d):
    posts = spark.createDataFrame([("/a.html", "A & a", "2024-01-01", "x"), ("/b.html", "B", "2024-01-02", None), ("/page-1.html", "P", "2024-01-03", None)], "path string, title string, day string, summary string")
    return reports.rss(posts.withColumn("published", F.to_timestamp("day")), "http://s", "T")


@query("SELECT * FROM (VALUES (1, '# c' || chr(10) || 'a = 1' || chr(10) || chr(10) || 'b:2')) t(id, text)")
def snk_properties(spark, d):
    from folio.sources import text_formats

    at = spark.createDataFrame([(1, "# c\na = 1\n\nb:2")], "id int, body string")
    return text_formats.properties_text(text_formats.properties(at, "id", "body").withColumn("name", F.when(F.col("name") == "a", "a ").otherwise(F.col("name"))), "id")


@query("SELECT '=== Test (#2)' || chr(10) || chr(10) || '* bbbbbbb second' || chr(10) || '* aaaaaaa initial import' AS document")
def snk_git_report(spark, d):
    at = spark.createDataFrame([(1, "a" * 40, "Test", "test@x.org", "2024-01-01", "initial import\n\nbody"), (2, "b" * 40, "Test", "test@x.org", "2024-01-02", "second")], "seq int, sha string, name string, email string, day string, message string")
    return reports.git_report(at.withColumn("ts", F.to_timestamp("day")))


@query("SELECT * FROM (VALUES ('g_seconds', 'summary', 0, 'quantile=0', 0.5), ('g_seconds', 'summary', 1, '_type_=sum', 4.25), ('go', 'gauge', 0, '', 9.0), ('k', NULL, 0, 'partition=9;topic=a,b', 2.7e7)) t(name, type, pos, tags, value)")
def src_open_metrics(spark, d):
    from folio.sources import text_formats

    at = text_formats.open_metrics(spark.createDataFrame([(1, _METRICS)], "id int, body string"), "id", "body")
    return at.select("name", "type", F.explode("values").alias("v")).select("name", "type", F.col("v.pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.map_entries("v.tags")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("tags"), F.col("v.value").alias("value"))


@query("SELECT * FROM (VALUES (0, '# c', 'a', '=', ' 1'), (1, '', NULL, NULL, NULL), (2, '', 'b.c', ':', 'x\\' || chr(10) || 'y'), (3, 'junk', NULL, NULL, NULL)) t(ord, comment, name, sep, value)")
def src_properties(spark, d):
    from folio.sources import text_formats

    at = spark.createDataFrame([(1, "# c\na = 1\n\nb.c:x\\\ny\njunk")], "id int, body string")
    return text_formats.properties(at, "id", "body").select("ord", "comment", "name", "sep", "value")


@query("SELECT * FROM (VALUES ('Gluon', '22.1', 'gln', '22.1-gln'), ('Gluon', '22.0', 'gln', '22.0-gln'), ('Zulu', '21.0', 'zulu', '21.0-zulu')) t(vendor, version, dist, identifier)")
def src_tool_versions(spark, d):
    from folio.sources import text_formats

    return text_formats.tool_versions(spark.createDataFrame([(1, _TABLE)], "id int, body string"), "id", "body").select("vendor", "version", "dist", "identifier")


@query("SELECT * FROM (VALUES ('1.8', 1), ('1.9', 1)) t(version, id)")
def src_old_tool_versions(spark, d):
    from folio.sources import text_formats

    rule = "=" * 80
    at = spark.createDataFrame([(1, f"{rule}\nAvailable Versions\n{rule}\n     1.9     1.8 \n\n{rule}\n+ local")], "id int, body string")
    return text_formats.old_tool_versions(at, "id", "body").select("version", "id")


@query("SELECT * FROM (VALUES ('java', 'Java', '21.0.2-tem', 'https://x.org/', 'A platform.')) t(tool, name, version, url, description)")
def src_tool_list(spark, d):
    from folio.sources import text_formats

    body = "=" * 80 + "\nAvailable\n" + "-" * 80 + "\nJava (21.0.2-tem)        https://x.org/\n\nA\nplatform.\n\n     $ sdk install java\n" + "-" * 80 + "\n"
    return text_formats.tool_list(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").drop("id")


@query("SELECT * FROM (VALUES (0, '1.0'), (1, '1.1')) t(pos, version)")
def src_maven_versions(spark, d):
    from folio.sources import text_formats

    return text_formats.maven_versions(spark.createDataFrame([(1, "<versions><version>1.0</version>\n<version>1.1</version></versions>")], "id int, body string"), "id", "body").drop("id")


@query("SELECT * FROM (VALUES ('zulu21-jdk21.0.1-linux_x64.zip', '21.0.1', 'jdk')) t(file, version, kind)")
def src_archive_links(spark, d):
    from folio.sources import text_formats

    body = '<a href="/zulu/bin/zulu21-jdk21.0.1-linux_x64.zip">x</a>\n<a href="zulu21-jdk21.0.1-linux_x64.zip">x</a><a href="zulu21-jre21-win.msi">y</a>'
    return text_formats.archive_links(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body", "linux_x64.zip").drop("id")


@query("SELECT '1.2.0' AS version")
def src_release_assets(spark, d):
    from folio.sources import text_formats

    at = spark.createDataFrame([("v1.2.0", [{"name": "linux"}]), ("v1.3.0", [{"name": "mac"}]), ("beta", [{"name": "linux"}])], "name string, assets array<struct<name:string>>")
    return text_formats.release_versions(at, "linux")


@query("SELECT * FROM (VALUES ('go', 'Does it.', 'a:java.lang.String:true')) t(goal, description, parameters)")
def src_plugin_goals(spark, d):
    from folio.sources import text_formats

    body = "<plugin><mojos><mojo><goal>go</goal><description>Does\n it.</description><parameters><parameter><name>a</name><type>java.lang.String</type><required>true</required></parameter></parameters></mojo></mojos></plugin>"
    at = text_formats.plugin_goals(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body")
    return at.select("goal", "description", F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string"))), ";").alias("parameters"))


@query("SELECT * FROM (VALUES (2, 1, 1, 0.5, 30)) t(executed, passed, failed, passed_share, nanos)")
def src_cucumber(spark, d):
    body = '[{"name":"f","elements":[{"name":"a","start_timestamp":"2024-01-02T00:00:00.000Z","steps":[{"result":{"status":"passed","duration":10}}]},{"name":"b","start_timestamp":"2024-01-01T00:00:00.000Z","steps":[{"result":{"status":"passed","duration":15}},{"result":{"status":"FAILED","duration":5}}]}]}]'
    at = spark.createDataFrame([(body,)], "j string").select(F.explode(F.from_json("j", "array<struct<name:string,elements:array<struct<keyword:string,id:string,name:string,line:int,type:string,start_timestamp:timestamp,steps:array<struct<keyword:string,name:string,line:int,result:struct<status:string,duration:bigint,error_message:string>>>>>>>")).alias("f")).select("f.*")
    return reports.run_summary(reports.scenario_results(at)).drop("first_start")


@query("SELECT * FROM (VALUES (1, 'main', 'a,b'), (1, 'next', 'c')) t(project, branch, titles)")
def src_commits_by_branch(spark, d):
    from folio.sources import remote

    at = spark.createDataFrame([(1, "main", 2, "b"), (1, "main", 1, "a"), (1, "next", 1, "c")], "project int, branch string, seq int, title string")
    return remote.commits_by_branch(at).select("project", F.explode("branches").alias("branch", "t")).select("project", "branch", F.array_join("t", ",").alias("titles"))


@query("SELECT * FROM (VALUES (1, 'name;n'), (2, 'a;1'), (3, ';2')) t(row, line)")
def src_sheet(spark, d):
    import io
    import zipfile

    from folio.sources import files

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><t>n</t></si><si><t>a</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1</v></c></row><row r="3"><c r="B3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    at = spark.createDataFrame([(1, bytearray(raw.getvalue()))], "id int, content binary")
    return files.sheet_rows(at, "id", "content").select("row", T.separated(F.col("cells")).alias("line"))


@query("SELECT * FROM (VALUES ('a.adoc', 'A', 'a.html'), ('x/b.adoc', 'B', 'c.html')) t(path, title, output)")
def src_markup_pages(spark, d):
    from folio.sources import files

    at = spark.createDataFrame([("a.adoc", "= A\n\ntext"), ("x/b.adoc", "= B\n:path: c.html\n\ntext"), ("_partials/p.adoc", "= P"), ("n.txt", "= N")], "path string, text string")
    return files.markup_pages(at, "path", "text").select("path", "title", "output")


@query("SELECT * FROM (VALUES ('apache-maven', '3.9.6'), ('tool', '1.0')) t(tool, version)")
def src_local_installs(spark, d):
    from folio.sources import files

    at = spark.createDataFrame([("/h/apache-maven-3.9.6-bin.tar.gz_exploded",), ("/h/tool-1.0_exploded",), ("/h/other",)], "p string")
    return files.local_installs(at, "p")


@query("SELECT * FROM (VALUES ('1.0'), ('1.1.0')) t(folder)")
def src_version_folders(spark, d):
    from folio.sources import files

    at = spark.createDataFrame([("/v/1.0",), ("/v/1.1.0",), ("/v/css",), ("/v/9.9",)], "p string")
    return files.version_folders(at, "p", ["9.9"], r"\d+(\.\d+)+")


@query("SELECT * FROM (VALUES ('x.svg', 'image/svg+xml'), ('x.webp', 'image/webp'), ('raw', 'image/png')) t(path, mime)")
def src_mime(spark, d):
    from folio.sources import files

    at = spark.createDataFrame([("x.svg", bytearray(b"<svg")), ("x.webp", bytearray(b"RIFF")), ("raw", bytearray(b"\x89PNG"))], "path string, content binary")
    return at.select("path", files.mime_type(F.col("path"), F.col("content")).alias("mime"))


@query("SELECT * FROM (VALUES ('z', 'a.txt', '1'), ('z', 'b/c.txt', '2')) t(id, name, text)")
def src_archive_entries(spark, d):
    import io
    import zipfile

    from folio.sources import files

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n, t in (("top/a.txt", "1"), ("top/b/c.txt", "2"), ("else.txt", "3")):
            z.writestr(n, t)
    at = spark.createDataFrame([("z", bytearray(raw.getvalue()))], "id string, content binary")
    return files.archive_entries(at, "id", "content", "top/").select("id", "name", F.decode("data", "UTF-8").alias("text"))


@query("SELECT * FROM (VALUES ('java.version', '17'), ('maven.version', '3.9')) t(name, value)")
def src_tool_settings(spark, d):
    from folio.sources import files

    at = spark.createDataFrame([(".sdkmanrc", "java", "17"), (".yemrc", "maven.version", "3.9")], "file string, name string, value string")
    return files.tool_settings(at, "file").select("name", "value")


@query("SELECT * FROM (VALUES (1, '17', '3.8'), (2, '21', NULL)) t(id, java, maven)")
def src_pom_versions(spark, d):
    from folio.sources import files

    at = spark.createDataFrame([(1, "<rules><requireMavenVersion><version>[3.8,)</version></requireMavenVersion><requireJavaVersion><version>[17,</version></requireJavaVersion></rules>"), (2, "<maven.compiler.release>21</maven.compiler.release>")], "id int, body string")
    return files.pom_versions(at, "id", "body")