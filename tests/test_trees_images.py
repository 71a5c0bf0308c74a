"""Ignore rules and container images on small trees."""

import json

from quillgraph.sources import ignores as I
from quillgraph.sources import images as M


def files(spark, texts):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")


def test_ignores(spark):
    texts = {
        ".gitignore": "# c\n*.log\n!keep.log\nbuild/\n/top\ndocs/**/draft?.md\n\\#odd\n[ab].o\nlib/**\n",
        "src/.gitignore": "!special.log\nlocal\n*.tmp\n!/sub/ok.tmp\n",
        "a.log": "", "keep.log": "", "x/a.log": "", "src/special.log": "", "build/keep.log": "", "x/build/y": "", "build": "", "top": "", "x/top": "", "docs/draft1.md": "", "docs/p/q/draft2.md": "", "docs/drafts.md": "", "docs/draft12.md": "", "#odd": "", "a.o": "", "c.o": "", "lib/x/y": "", "src/local/z": "", "local": "", "src/sub/ok.tmp": "", "src/sub/no.tmp": "", "src/ok.tmp": "",
    }
    tree = files(spark, texts)
    kept = {r.path for r in I.unignored(tree, I.rules_of(tree)).collect()} - {".gitignore", "src/.gitignore"}
    assert kept == {"keep.log", "src/special.log", "build", "x/top", "docs/draft12.md", "c.o", "local", "src/sub/ok.tmp"}
    assert I.pattern_of("") is None is I.pattern_of("/") and I.unignored(tree, I.rules_of(tree.limit(0))).count() == len(texts)
    assert [r[0] for r in spark.createDataFrame([("é",), (None,)], "n string").select(I.composed("n")).collect()] == ["é", None]


def test_images(spark):
    config = {"os": "linux", "architecture": "amd64", "history": [{"created_by": "one"}, {"created_by": "env", "empty_layer": True}, {"created_by": "two"}], "rootfs": {"diff_ids": ["sha256:d1", "sha256:d2", "sha256:d3"]}}
    manifest = {"config": {"digest": "sha256:cfg"}, "layers": [{"digest": "sha256:l1"}, {"digest": "sha256:l2"}, {"digest": "sha256:l3"}]}
    arm = {"config": {"digest": "sha256:none"}, "layers": [{"digest": "sha256:a1"}]}
    index = {"manifests": [{"mediaType": "application/vnd.oci.image.index.v1+json", "digest": "sha256:idx", "annotations": {"org.opencontainers.image.ref.name": "v1"}}]}
    inner = {"manifests": [{"digest": "sha256:amd", "platform": {"os": "linux", "architecture": "amd64"}}, {"digest": "sha256:arm7", "platform": {"os": "linux", "architecture": "arm", "variant": "v7"}}, {"digest": "sha256:att", "platform": {"os": "unknown", "architecture": "unknown"}}]}
    saved = [{"Config": "abc.json", "RepoTags": ["x:1"], "Layers": ["l1/layer.tar", "l2/layer.tar", "l3/layer.tar"]}]
    texts = {"img/index.json": index, "img/blobs/sha256/idx": inner, "img/blobs/sha256/amd": manifest, "img/blobs/sha256/arm7": arm, "img/blobs/sha256/cfg": config, "sav/manifest.json": saved, "sav/abc.json": config}
    tree = files(spark, {k: json.dumps(v) for k, v in texts.items()})
    images = M.platforms_of(tree)
    assert sorted((r.digest, r.os, r.arch, r.variant, r.tag) for r in images.collect()) == [("sha256:amd", "linux", "amd64", None, "v1"), ("sha256:arm7", "linux", "arm", "v7", "v1")]
    pick = lambda *a: [(r.root, r.digest) for r in M.chosen(images, *a).collect()]
    assert pick() == [("img/", "sha256:amd")] and pick("linux", "arm", "v7") == [("img/", "sha256:arm7")] and pick("linux", "arm", "v6") == [] == pick("windows", "amd64")
    rows = lambda df: sorted((r.ordinal, r.digest, r.diff_id, r.created_by) for r in df.collect())
    assert rows(M.oci_layers(tree, M.chosen(images))) == [(0, "sha256:l1", "sha256:d1", "one"), (1, "sha256:l2", "sha256:d2", "two"), (2, "sha256:l3", "sha256:d3", None)]
    assert rows(M.oci_layers(tree, M.chosen(images, "linux", "arm"))) == [(0, "sha256:a1", None, None)]
    assert rows(M.saved_layers(tree)) == [(0, "l1/layer.tar", "sha256:d1", "one"), (1, "l2/layer.tar", "sha256:d2", "two"), (2, "l3/layer.tar", "sha256:d3", None)]
    bare = [{"digest": "sha256:b2", "platform": None}, {"digest": "sha256:b1"}]
    assert [(r.root, r.digest) for r in M.chosen(M.platforms_of(files(spark, {"index.json": json.dumps({"manifests": bare})}))).collect()] == [("", "sha256:b1")]
