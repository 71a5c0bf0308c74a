"""Project files with parents, grandparents, imported lists, cycles and missing parents."""

from quillgraph.sources import poms as P


def project(name, parent=None, version="1", properties="", managed="", needs=""):
    up = f"<parent><groupId>g</groupId><artifactId>{parent[0]}</artifactId><version>{parent[1]}</version></parent>" if parent else ""
    own = f"<version>{version}</version>" if version else ""
    return f"<project xmlns='m'><groupId>g</groupId><artifactId>{name}</artifactId>{own}{up}<properties>{properties}</properties><dependencyManagement><dependencies>{managed}</dependencies></dependencyManagement><dependencies>{needs}</dependencies></project>"


def need(name, version=None, scope=None, kind=None, optional=False):
    tag = lambda t, v: f"<{t}>{v}</{t}>" if v else ""
    return f"<dependency><groupId>g</groupId><artifactId>{name}</artifactId>{tag('version', version)}{tag('scope', scope)}{tag('type', kind)}{'<optional>true</optional>' if optional else ''}</dependency>"


def test_effective_needs(spark):
    files = {
        "top/pom.xml": project("top", properties="<a>1</a><b>${a}.5</b>", managed=need("m", "${b}", "test") + need("n", "7")),
        "mid/pom.xml": project("mid", ("top", "1"), properties="<a>2</a>", managed=need("n", "8") + need("lists", "${lists}", "import", "pom")),
        "app/pom.xml": project("app", ("mid", "1"), None, properties="<lists>3</lists>", needs=need("m") + need("n") + need("own", "${project.version}") + need("listed") + need("deep", optional=True) + need("nobody") + need("n2", "${a}", "provided")),
        "lists-3.pom": project("lists", version="3", properties="<a>9</a>", managed=need("listed", "L${a}") + need("n", "99") + need("more", "1", "import", "pom")),
        "more/pom.xml": project("more", managed=need("deep", "D") + need("listed", "no") + need("lists", "3", "import", "pom")),
        "loop1/pom.xml": project("loop1", ("loop2", "1"), needs=need("x", "${p}")),
        "loop2/pom.xml": project("loop2", ("loop1", "1"), properties="<p>4</p>"),
        "orphan/pom.xml": project("orphan", ("gone", "1"), needs=need("x", "${project.parent.version}")),
        "bad/pom.xml": "<project",
        "evil/pom.xml": "<!DOCTYPE x><project/>",
    }
    tree = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")
    got = {}
    for r in P.effective_needs(tree).collect():
        got.setdefault(r.path, {})[r.name.removeprefix("g:")] = (r.version, r.scope, r.optional)
    assert got == {
        "app/pom.xml": {"m": ("2.5", "test", False), "n": ("8", "compile", False), "own": ("1", "compile", False), "listed": ("L9", "compile", False), "deep": ("D", "compile", True), "nobody": (None, "compile", False), "n2": ("2", "provided", False)},
        "loop1/pom.xml": {"x": ("4", "compile", False)},
        "orphan/pom.xml": {"x": ("1", "compile", False)},
    }
    assert P.effective_needs(tree.limit(0)).count() == 0
