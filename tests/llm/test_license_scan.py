import duckdb

from reviewlens.llm import license_scan as L
from reviewlens.llm.oracles import ORACLES
from tests.llm.helpers import docs, with_clashes

ROWS = [
    (1, None), (2, ""), (3, "...!"), (4, "Under the MIT license, under the mit-license UNDER THE MIT LICENSE"),
    (5, "Apache License, Version 2.0\nLicensed under CC BY-NC 4.0."), (6, "cc by nc cc by nc cc by"),
    (7, "This work is licensed under the GNU General Public License, version 3."),
    (8, "This work is licensed under the GNU Public License\nversion 3"), (9, "Released under the MIT License."),
    (10, "the mit license under"), (11, "Kelvin K sign: under the mit license"), (12, "x y é–z 1a2b"),
    (13, "\n".join(["plain line of words"] * 500) + "\nlicensed under the apache license version 2 0"),
    (14, "redistribution and use in source forms with or without modification are permitted binary"), (15, "by version license the of"),
    (16, "Released under the BSD License."), (17, "Licensed under CC BY 4.0."), (18, "Licensed under CC BY-SA\n4.0"),
    (19, "the store was released late under a roof, but the license of the driver held"),
    (20, "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"),
    (21, "long " * 3_001 + "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public "
         "License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version." + " words" * 999),
    (22, "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying "
         "documentation covered by\nthis license"), (23, "the mit license"), (24, "released " + "x " * 40 + "under the mit license of"),
    *[(30 + i, "a " * i + "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is granted")
      for i in range(40)]]

LABELS = {7: "gpl-3", 8: "", 9: "mit", 13: "apache-2", 14: "", 15: "", 16: "bsd", 17: "cc-by", 18: "cc-by-sa", 19: "", 20: "bsd", 21: "gpl-3",
          22: "boost", 23: "", 24: "mit", **{30 + i: "isc" for i in range(40)}}


def test_matches_the_sql_form(spark):
    got = L.license_scan(with_clashes(docs(spark, ROWS))).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    want = con.sql(ORACLES["op3_license_scan"]).fetchall()
    clean = lambda v: None if v is None or v != v else v     # noqa: E731
    assert sorted(tuple(map(clean, r)) for r in got.itertuples(index=False)) == sorted(want)
    rows = {r[0]: r for r in want}
    assert rows[4][2:5] == (3, 0, 8) and rows[6][2] == 2 and rows[5][6] == "apache-2,cc-by-nc"
    assert {i: rows[i][6] for i in LABELS} == LABELS


def test_every_notice_is_found_as_printed(spark):
    """Also where it is wrapped, and nothing else is found in it than what it says."""
    notices = [(notice, label) for notice, _, label in L.TEMPLATES]
    rows = [(i, f"{'word ' * i}{notice.replace(' ', chr(10), 3)}.") for i, (notice, _) in enumerate(notices)]
    got = {r["doc_id"]: r for r in L.license_scan(docs(spark, rows)).collect()}
    assert {i: got[i]["labels"] for i in got} == {i: label for i, (_, label) in enumerate(notices)}
    assert all(r["score"] == 1 for r in got.values())


def test_repeated_null_ids_and_empty(spark):
    rows = [(1, "under the mit license")] * 2 + [(1, "cc by nc"), (None, "cc by nc"), (None, None)]
    got = L.license_scan(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["base_labels"]) for r in got) == [(0, ""), (0, "cc-by-nc"), (1, "cc-by-nc"), (1, "mit"), (1, "mit")]
    assert L.license_scan(docs(spark, [])).count() == 0


def test_prefix_covers_every_sufficient_overlap():
    for _, _, t, least, prefix, *_ in L.template_table(frequency={"the": 9, "license": 5}):
        assert len(prefix) == len(t) - least + 1 and t[:len(prefix)] == prefix
        # a set with `least` of the words misses at most len(t) - least of them, one less than the prefix
        assert set(prefix) & set(t[len(t) - least:])
