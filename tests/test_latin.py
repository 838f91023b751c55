"""The reduced character sets of texts: each form made once, whatever the text holds."""

import hashlib
import random
import re
import unicodedata

import __spark_entry__ as entry
from leafloom.operators import pages as ops


def test_each_form_is_made_once(spark, sf):
    plan = entry.queries()["latin1_fold"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("translate("), plan.count("regexp_replace(")) == (2, 4)


def test_forms_of_odd_texts(spark):
    rnd = random.Random(5)
    kinds = ["a", "\n", "\t", "\r", "\x0b", "\x7f", "\x85", "\xa0", "\xff", "é", "ø", "́", "ế", "…", "–", "—", "―", "‘", "’", "‚", "“", "”", "„", "‛", "†", "€", "漢", "\U0001f600"]
    texts = ["", None, "plain", *("".join(rnd.choice(kinds) for _ in range(rnd.randrange(1, 12))) for _ in range(2000))]

    def forms(text):
        plain = text.replace("…", "...").translate(str.maketrans("–—―‘’‚“”„", "---'''\"\"\""))
        odd = "[^\t\n\r\x20-\x7e\xa0-\xff]"
        bare = re.sub("[̀-ͯ]", "", "".join(y if len(y := re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", c))) == 1 else c for c in plain))
        return [re.sub(odd, "?", plain), re.sub(odd, "", plain), re.sub("[^\x20-\x7e]", "", bare)]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: tuple(r)[1:] for r in ops.latin1_report(docs).collect()}
    for i, text in enumerate(texts):
        want = (None,) * 6 if text is None else (*(hashlib.md5(x.encode()).hexdigest() for x in forms(text)), *(x != text for x in forms(text)))
        assert got[i] == want, text
