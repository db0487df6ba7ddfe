"""Patches: texts that are not named, odd parents, and work in proportion to the documents."""

import json
import time

from turnloom.operators import patch as P
from turnloom.operators.patch import apply_patches


def test_texts_stay_and_plain_parents(spark):
    """Unnamed values keep their text to the byte; a patch below a plain value changes nothing (its key was once lost)."""
    doc = '\n { "a" : "x\\u00fc\\/", "n": 1.50, "big": 123456789012345678901234567890, "o" : { "k" : [ 1,  2 ] , "z":null} } '
    rows = [(1, 0, ["a", "x"], None, "1"), (1, 1, ["o", "z"], None, '"new"'), (1, 2, ["o", "m"], "k", "7"), (1, 3, ["o", "m"], "k", "8"), (1, 4, ["n", "0", "q"], None, "1")]
    p = spark.createDataFrame(rows, "id int, ord int, path array<string>, after string, value string")
    got = apply_patches(spark.createDataFrame([(1, doc), (2, doc), (3, '{"a":1,"a":2}')], "id int, js string"), p, ["id"], "js").collect()
    got = {r.id: (r.js, r.patches) for r in got}
    assert got[1] == ('{"a":"x\\u00fc\\/","n":1.50,"big":123456789012345678901234567890,"o":{"k":[ 1,  2 ],"m":8,"z":"new"}}', 5)
    assert got[2] == (doc, 0) and got[3] == ('{"a":1,"a":2}', 0)


def test_time_of_a_document():
    """A document of seven lines with four patches took about half a millisecond of a core, now some hundredths of one."""
    doc = json.dumps({"status": "P", "items": [{"line": k, "flag": "R", "mode": "O"} for k in range(7)]})
    patches = [(["items", "1", "heavy"], "line", "true"), (["items", "4", "flag"], None, '"returned"'), (["items", "5", "flag"], None, '"returned"'), (["items", "-"], None, '{"line":0}')]
    began = time.process_time()
    out = P.patched_texts([doc] * 5000, [patches] * 5000)[-1]
    assert time.process_time() - began < 5000 * 2e-4
    assert json.loads(out)["items"][-1] == {"line": 0} and json.loads(out)["items"][1] == {"line": 1, "heavy": True, "flag": "R", "mode": "O"}
