from collections import defaultdict

from earshot.llm.site_lines import boilerplate_lines, cut_lines, without_boilerplate


def brute(rows, min_sites):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None:
                sites[line.strip(" ")].add(site)
    out = []
    for doc_id, text, site in rows:
        if text is not None:
            lines = text.split("\n")
            gone = [bool(line.strip(" ")) and len(sites[line.strip(" ")]) >= min_sites for line in lines]
            if any(line.strip(" ") and not g for line, g in zip(lines, gone)):  # else nothing of its own would be left
                text = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc_id, text, site))
    return out


def rows():
    out = []
    for i in range(60):
        body = f"own line {i}\nanother line of document {i}\n  shared by all  \n\nshared by {i % 3}"
        out.append((i, body, f"site{i % 12}"))
    out += [(100, None, "site1"), (101, "", "site2"), (102, "shared by all", "site3"), (103, "shared by all\n" + "long " * 100_000, None), (None, out[0][1], "site0")]
    out += [out[0], out[0], (0, "another text of id 0\nshared by all", "site5")]
    return out


def key(row):
    return repr(row)


def test_equals_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, cut string")  # the site column is called like a result
    for least in (2, 4, 5, 12, 13):
        got = [(r[0], r[1], r[2]) for r in without_boilerplate(docs, "cut", least).collect()]
        assert sorted(got, key=key) == sorted(brute(data, least), key=key), least


def test_near_the_limit_counts_are_exact(spark):
    # Sketches this coarse are wrong by far more than one site; the exact count in the band decides.
    data = [(i, f"a{i % 40}\nb{i % 40}", f"s{i // 40}") for i in range(40 * 30)] + [(9999, "a0", "s99")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert boilerplate_lines(docs, "source", 31, lg_k=4, band=0.9).count() == 1
    assert boilerplate_lines(docs, "source", 30, lg_k=4, band=0.9).count() == 80


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert without_boilerplate(docs).collect() == []
    filled = spark.createDataFrame([(1, "a\nb", "s")], "doc_id long, text string, source string")
    assert cut_lines(filled, boilerplate_lines(docs, "source", 2)).first().text == "a\nb"
