"""Text rules on literals."""

import pytest
from pyspark.sql import functions as F

from folio.functions import asciidoc, codecs, markup
from folio.functions import text as T
from folio.functions.stemming import measure, shape, stem
from folio.operators.retrieval import CHUNK, windows_of


@pytest.mark.parametrize(
    ("word", "index", "query"),
    [
        ("reliable", "reliab", "reli"), ("as", "as", "as"), ("caresses", "caress", "caress"), ("ponies", "poni", "poni"), ("cats", "cat", "cat"), ("agreed", "agre", "agre"), ("feed", "feed", "feed"),
        ("hopping", "hop", "hop"), ("falling", "fall", "fall"), ("filing", "file", "file"), ("conflated", "confla", "confl"), ("happy", "happi", "happi"), ("sky", "sky", "sky"), ("relational", "rela", "rel"),
        ("adoption", "adoption", "adopt"), ("roll", "roll", "roll"), ("controll", "control", "control"), ("java17", "java17", "java17"), ("document", "docu", "docu"), ("classes", "class", "class"),
    ],
)
def test_stems(word, index, query):
    assert (stem(word), stem(word, True)) == (index, query)


def test_shapes():
    assert shape("syzygy") == "cvcvcv" and shape("yes") == "cvc" and measure("trouble") == 1 and measure("oaten") == 2


def test_windows_cover_the_text():
    text = ("word " * 50 + "end. ") * 30
    spans = windows_of(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b > c for (_, b), (c, _) in zip(spans, spans[1:], strict=False)) and all(b - a <= CHUNK + 1 for a, b in spans)
    assert all(text[b - 1] == "." for _, b in spans[:-1])
    assert windows_of("") == [] and windows_of("ab") == [(0, 2)]
    assert windows_of("A" * 1000) == [(0, 800), (680, 1000)]


def test_templates():
    assert markup.substituted("a {{{x}}} {{{y:-z}}} {{{n}}} ${{{x}}}", {"x": "{{{w}}}", "w": "1"}) == "a 1 z {{{n}}} {{{x}}}"
    assert markup.substituted("{{{x}}}|site:no-interpolate:start{{{x}}}site:no-interpolate:end|{$site.openbracket$}{{{x}}}", {"x": "1"}).endswith("{{{x}}}|{1")
    with pytest.raises(ValueError, match="itself"):
        markup.substituted("{{{a}}}", {"a": "{{{b}}}", "b": "{{{a}}}"})


def test_codecs(spark):
    df = spark.createDataFrame([("secret",), ("",), (None,), ("é😀",)], "v string")
    salt, iv, short = (F.unhex(F.lit(x)) for x in ("00112233445566778899aabbccddeeff", "00" * 12, "0102030405060708"))
    sealed = df.select("v", codecs.gcm_encrypt(F.col("v"), "p", salt, iv).alias("g"), codecs.cbc_encrypt(F.col("v"), "p", short).alias("c"))
    for r in sealed.select("v", "g", "c", codecs.gcm_decrypt(F.col("g"), "p").alias("g2"), codecs.cbc_decrypt(F.col("c"), "p").alias("c2"), codecs.is_gcm(F.col("g")).alias("ig"), codecs.is_cbc(F.col("c")).alias("ic")).collect():
        assert r.g2 == r.v and r.c2 == r.v
        if r.v:
            assert r.ig and r.ic and r.g.startswith("ENC[AES256_GCM,data:") and r.c[0] == "{" and r.c[-1] == "}"


def test_tagged_lines(spark):
    text = "a\n# tag::x[]\nb\n# end::x[]\nc\n# tag::y[]\nd\n# end::y[]"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*[T.tagged_lines(F.col("t"), r).alias(str(k)) for k, r in enumerate(["x", "**", "*", "!y", "**,!x"])]).first()
    assert list(got) == ["b", "a\nb\nc\nd", "b\nd", "a\nb\nc", "a\nc\nd"]


PARAGRAPH = ' <div class="paragraph">\n <p>\n{}\n </p>\n </div>\n'


def para(inner):
    """A paragraph with spans other than plain text."""
    return f' <div class="paragraph">\n <p>{inner}</p>\n </div>\n'


def section(level, anchor, title, body):
    return f' <div class="sect{level - 1}" id="{anchor}">\n  <h{level}>{title}</h{level}>\n <div class="sectionbody">\n{body} </div>\n </div>\n'


def entries(*texts):
    return "".join(f"  <li>\n <p>\n{x}\n </p>\n  </li>\n" for x in texts)


def th(text, spans="", side="left"):
    return f'    <th class="tableblock halign-{side}"{spans}>\n{text}    </th>\n'


def td(text, spans="", side="left"):
    return f'    <td class="tableblock halign-{side}"{spans}>\n<p class="tableblock">\n{text}</p>\n    </td>\n'


def grid(head, rows, classes="frame-all grid-all", cols=()):
    line = lambda cells: "   <tr>\n" + "".join(cells) + "   </tr>\n"
    shown = "".join(f'   <col style="width: {w}%;">\n' for w in cols)
    top = f"  <thead>\n{line(head)}  </thead>\n" if head else ""
    body = "  <tbody>\n" + "".join(map(line, rows)) + "  </tbody>\n" if rows else ""
    return f' <table class="tableblock {classes} stretch">\n  <colgroup>\n{shown}  </colgroup>\n{top}{body} </table>\n'


@pytest.mark.parametrize(
    ("source", "html"),
    [
        (":idprefix: ch-\n\n== Spring harvest\n\nPlums ripen.", section(2, "ch-spring_harvest", "Spring harvest", PARAGRAPH.format("Plums ripen."))),
        ("# River log\n\nLow tide.", section(1, "_river_log", "River log", PARAGRAPH.format("Low tide."))),
        ("== Valve `v7`", section(2, "_valve_v7", "Valve <code>v7</code>", "")),
        (". soak\n. rinse\n. dry", f' <div class="olist">\n <ol>\n{entries("soak", "rinse", "dry")} </ol>\n </div>\n'),
        ("a. north wing\nb. south wing", f' <div class="olist loweralpha">\n <ol class="loweralpha" type="a">\n{entries("north wing", "south wing")} </ol>\n </div>\n'),
        ("i) dawn\nii) dusk", f' <div class="olist lowerroman">\n <ol class="lowerroman" type="i">\n{entries("dawn", "dusk")} </ol>\n </div>\n'),
        ("* [x] lamps\n* [ ] ropes", '  <div class="ulist checklist">\n  <ul class="checklist">\n   <li>\n    <p>&#10003; lamps</p>\n   </li>\n   <li>\n    <p>&#10063; ropes</p>\n   </li>\n  </ul>\n  </div>\n '),
        ("oak:: hard\npine:: soft", ' <div class="dlist">\n  <dl>\n    <dt class="hdlist1">oak</dt>\n    <dd>\n<p>hard</p>\n</dd>\n    <dt class="hdlist1">pine</dt>\n    <dd>\n<p>soft</p>\n</dd>\n  </dl>\n </div>\n'),
        ("[source,sql]\n----\nselect 1 from tide;\n----", ' <div class="listingblock">\n <div class="content">\n <pre class="highlightjs highlight"><code class="language-sql hljs" data-lang="sql">select 1 from tide;\n</code></pre>\n </div>\n </div>\n'),
        (":deep: yes\n\nifdef::deep[]\nanchor chain\nendif::[]\nifndef::deep[]\npaddle\nendif::[]", PARAGRAPH.format("anchor chain")),
        ("ifeval::[2 > 3]\nnever\nendif::[]\nalways", PARAGRAPH.format("always")),
        ("////\nhidden remark\n////\nshown remark", PARAGRAPH.format("shown remark")),
        ("https://tides.example/map", ' <a href="https://tides.example/map">https://tides.example/map</a>\n'),
        ("link:https://tides.example/v[`gauge`]", ' <a href="https://tides.example/v"><code>gauge</code></a>\n'),
        ("link:https://tides.example/v[see image:buoy.png[red buoy]]", ' <a href="https://tides.example/v">see  <span class="image"><img src="buoy.png" alt="red buoy"></span>\n</a>\n'),
        ("xref:harbour.adoc[Quay]", ' <a href="harbour.html">Quay</a>\n'),
        (":relfileprefix: ../../\n:relfilesuffix: /\n\nxref:harbour.adoc[Quay]\n", ' <a href="../../harbour/">Quay</a>\n'),
        ("icon:fas fa-anchor[]", '<span class="icon"><i class="fas fa-anchor"></i></span>'),
        ("Mind the **wet** deck.", para("Mind the <strong>wet</strong> deck.")),
        ("Row __slowly__ now.", para("Row <em>slowly</em> now.")),
        ("Fare is ~~9~~ 7.", para("Fare is <del>9</del> 7.")),
        ("H~2~O and m^2^.", para("H<sub>2</sub>O and m<sup>2</sup>.")),
        ("Watch the #red# light.", para("Watch the <mark>red</mark> light.")),
        ("read [the chart](https://tides.example/c) first", para('read  <a href="https://tides.example/c">the chart</a>\n first')),
        ("see ![buoy](buoy.png) there", para('see  <span class="image"><img src="buoy.png" alt="buoy"></span>\n there')),
        ("Cast off  \nHoist sail", ' <div class="paragraph">\nCast off<br>\nHoist sail </div>\n'),
        ("[sidebar]\n****\nLocal lore\n****", ' <div class="sidebarblock">\n  <div class="content">\nLocal lore  </div>\n </div>\n'),
        ("Ebb\n\n---\n\nFlood", PARAGRAPH.format("Ebb") + " <hr>\n" + PARAGRAPH.format("Flood")),
        ("TIP: carry a spare oar.", ' <div class="admonitionblock tip">\n  <table>\n    <tbody>\n     <tr>\n      <td class="icon">\n     <div class="title">TIP</div>\n       </td>\n      <td class="content">\ncarry a spare oar.    </td>\n   </tr>\n      </tbody>\n  </table>\n </div>\n'),
        ("{counter:boat:7} {counter:boat}", para("7 8")),
        ("{counter2:knot} {counter2:knot}", para("0 1")),
        ("indexterm::[mooring]\n\nrope", ' <a id="indexterm-1"></a>\n' + PARAGRAPH.format("rope")),
        ("[latexmath]\n++++\na^2 + b^2\n++++", ' <div class="stemblock">\n  <div class="content">\n \\[a^2 + b^2\\]   </div>\n </div>\n'),
        ("Speed stem:[d/t] matters.", para("Speed  \\$d/t\\$  matters.")),
        ("image::quay.png[pier,width=64,height=48,.left.w30]", ' <div class="imageblock left w30">\n <div class="content">\n <img src="quay.png" alt="pier" width="64" height="48">\n </div>\n </div>\n'),
        ("image::quay.png[Pier,link=tides.example/p,window=_blank]", ' <div class="imageblock">\n <div class="content">\n <a href="tides.example/p" target="_blank" rel="noopener">\n  <img src="quay.png" alt="Pier">\n </a>\n </div>\n </div>\n'),
        ("image::quay.png[Pier,link=tides.example/p,opts=nofollow]", ' <div class="imageblock">\n <div class="content">\n <a href="tides.example/p" rel="nofollow">\n  <img src="quay.png" alt="Pier">\n </a>\n </div>\n </div>\n'),
        (":imagesdir: /pics/\n\nimage::quay.png[]", ' <div class="imageblock">\n <div class="content">\n <img src="/pics/quay.png" alt="quay.png">\n </div>\n </div>\n'),
        ("[quote, Ada Harbourmaster, Night Log]\n____\nFog again.\n____", ' <div class="quoteblock">\n  <blockquote>\nFog again.  </blockquote>\n  <div class="attribution">\n&#8212; Ada Harbourmaster<br>\n<cite>Night Log</cite>\n  </div>\n </div>'),
        ("Press kbd:[F2].", para("Press  <kbd>F2</kbd>\n.")),
        ("audio::waves.ogg[loop=1]", ' <div class="audioblock">\n <div class="content">\n  <audio src="waves.ogg" controls loop>\n  Your browser does not support the audio tag.\n  </audio>\n </div>\n </div>\n'),
        ("video::surf.mp4[still.png,start=3,end=9,width=320]", ' <div class="videoblock">\n <div class="content">\n  <video src="surf.mp4#t=3,9" width="320" poster="still.png" controls>\n  Your browser does not support the video tag.\n  </video>\n </div>\n </div>\n'),
        ("video::k3y[youtube,start=7,nofullscreen=1]", ' <div class="videoblock">\n <div class="content">\n  <iframe src="https://www.youtube.com/embed/k3y?rel=0&amp;start=7&amp;fs=0" frameborder="0">\n  </iframe>\n </div>\n </div>\n'),
        ("video::77[vimeo,start=4,loop=1]", ' <div class="videoblock">\n <div class="content">\n  <iframe src="https://player.vimeo.com/video/77?&amp;loop=1#at=4" frameborder="0" allowfullscreen>\n  </iframe>\n </div>\n </div>\n'.replace("77?", "77")),
        ("counter:oar[4]{counter:oar}", para("5")),
        ("[verse]\n____\nwide sea\ngrey sky\n____", ' <div class="verseblock">\n  <pre class="content">\nwide sea grey sky  </pre>\n </div>'),
        ("[qanda]\nWhy:: Wind\nHow:: Sail\n", ' <div class="qlist qanda">\n  <ol>\n   <li>\n    <p><em>Why</em></p>\n    <p>Wind</p>\n   </li>\n   <li>\n    <p><em>How</em></p>\n    <p>Sail</p>\n   </li>\n  </ol>\n </div>\n'),
        ("[horizontal]\nbow:: front\nstern:: back\n", ' <div class="hdlist">\n  <table>\n   <tr>\n    <td class="hdlist1">bow</td>\n    <td class="hdlist2">\nfront    </td>\n   </tr>\n   <tr>\n    <td class="hdlist1">stern</td>\n    <td class="hdlist2">\nback    </td>\n   </tr>\n  </table>\n </div>\n'),
        ("Look up [[[log7]]] first.", para('Look up <a id="log7"></a>\n first.')),
        ("[%linenums]\n[source,py]\n----\na = 1\nb = 2\n----", ' <div class="listingblock">\n <div class="content">\n <pre class="highlightjs highlight linenums"><code class="language-py hljs" data-lang="py" data-linenums="true"><span class="linenums">1</span>a = 1\n<span class="linenums">2</span>b = 2\n</code></pre>\n </div>\n </div>\n'),
        ("|===\n| knot | hitch\n| 4 | 7\n|===", grid([th("knot"), th("hitch")], [[td("4"), td("7")]])),
        ("|===\n|2+| ropes | sails\n|===", grid([th(" <p>\nropes\n </p>\n", ' colspan="2"'), th("sails")], [])),
        ("|===\n|.2+| tall | x\n|===", grid([th(" <p>\ntall\n </p>\n", ' rowspan="2"'), th("x")], [])),
        ("[stripes=odd,frame=topbot,grid=rows]\n|===\n| a\n| b\n|===", grid([th("a")], [[td("b")]], "frame-ends grid-rows stripes-odd")),
        ('[cols="^2,>1"]\n|===\n| mid | end\n\n|x\n|y\n|===', grid([th(" mid ", side="center"), th(" end", side="right")], [[td("x", side="center"), td("y", side="right")]], cols=(66, 33))),
        ("[%noheader]\n|===\n| a | b\n|===", grid([], [[td("a"), td("b")]])),
        ("menu:Deck[Lower]", ' <span class="menuseq"><b class="menu">Deck</b>&#160;<b class="caret">&#8250;</b> <b class="menuitem">Lower</b></span>\n'),
        ("menu:Deck[]", ' <b class="menuref">Deck</b>\n'),
        ("Press kbd:[Alt+K] or btn:[Stow].", para('Press <kbd>Alt</kbd> + <kbd>K</kbd>\n or  <b class="button">Stow</b>\n.')),
        ("Depth footnote:mark[Sounded by hand.] and footnote:mark[] later.", para('Depth  <sup class="footnote" id="_footnote_mark">[<a id="_footnoteref_1" class="footnote" href="#_footnotedef_1" title="View footnote.">1</a>]</sup>\n and  <sup class="footnoteref">[<a class="footnote" href="#_footnotedef_1" title="View footnote.">1</a>]</sup>\n later.') + ' <div id="footnotes">\n  <hr>\n  <div class="footnote" id="_footnotedef_1">\n   <a href="#_footnoteref_1">1</a>. Sounded by hand.\n  </div>\n </div>\n'),
    ],
)
def test_documents(source, html):
    assert asciidoc.to_html(source, header=False) == html


def test_macros_of_the_caller():
    assert asciidoc.to_html("See tide:now[high] there.", macros={"tide": lambda n: f"<i>{n.text}/{n.options['label']}</i>"}) == para("See <i>now/high</i> there.")


def test_drawings():
    text = "+------+   +.....+\n|[box] |-->|     |\n+------+   +.....+\n\n  ^\n  :\n  +---- to sea  side    away\n[box]: {\"fill\":\"#123\",\"x:y\":1}\n[11,0]: {\"id\":\"r\"}"
    found, options = markup.drawing(text)
    assert options == {"box": {"fill": "#123", "x:y": 1}, "11,0": {"id": "r"}}
    shown = [(o["kind"], o["corners"], o["dashed"], o["start"], o["end"], o["text"], o["tag"]) for o in found]
    assert shown == [
        ("closed", [(0, 0), (7, 0), (7, 2), (0, 2)], False, False, False, "", "box"), ("closed", [(11, 0), (17, 0), (17, 2), (11, 2)], False, False, False, "", "11,0"),
        ("open", [(8, 1), (10, 1)], False, False, True, "", ""), ("open", [(2, 4), (2, 6), (6, 6)], True, True, False, "", ""),
        ("text", [(1, 1)], False, False, False, "[box]", "box"), ("text", [(8, 6)], False, False, False, "to sea  side", ""), ("text", [(24, 6)], False, False, False, "away", ""),
    ]
    out = markup.svg_of(text)
    assert '<path d="M 4 8 L 67 8 L 67 40 L 4 40 Z" stroke="#000" fill="#123"/>' in out and 'fill="#fff" font-family="monospace">[box]</text>' in out and 'marker-end="url(#tip)"' in out and "x:y" not in out
    assert markup.drawing("") == ([], {})


def test_markdown():
    assert markup.markdown_html("## Locks & keys\n\n* turn `a<b` **twice**\n- see [the *map*](/m?a&b)\n\n1 * 2 * 3\r\n__old__ _x_ ** y") == "\n".join(
        ["<h2>Locks &amp; keys</h2>", "<ul>", "<li>turn <code>a&lt;b</code> <strong>twice</strong></li>", '<li>see <a href="/m?a&amp;b" target="_blank" rel="noopener">the <em>map</em></a></li>', "</ul>", "<p>1 <em> 2 </em> 3</p>", "<p><strong>old</strong> _x_ ** y</p>"]
    )
    assert markup.markdown_html("") == "" and markup.spans("**a") == "**a" and markup.spans("[a](b c)") == "[a](b c)"


def test_includes_and_tables():
    parts = {"hull.adoc": "keel plank\n\ninclude::mast.adoc[]\n", "mast.adoc": "top plank\n"}
    assert asciidoc.to_html("= Boat\n\ninclude::hull.adoc[]\n", include=parts.get).count("plank") == 2
    with pytest.raises(ValueError, match="no such include"):
        asciidoc.to_html("include::rudder.adoc[]", include=parts.get)
    with pytest.raises(ValueError, match="deeper"):
        asciidoc.to_html("include::me[]", include=lambda p: "include::me[]")
    out = asciidoc.to_html('[cols="1,1"]\n|===\n|h1 |h2\n\n|a\n|b\n|===')
    assert out.count("<th ") == 2 and out.count("<td ") == 2 and "width: 50%" in out


def test_options():
    assert asciidoc.options_of('source,java,.r1.r2#me%opt,a="b,c"', "style") == {"style": "source", "1": "java", "role": "r1 r2", "id": "me", "opts": "opt", "a": "b,c"}
