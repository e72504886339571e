from pyspark.sql import functions as F

from quarrymill.operators import cleaning as c


def test_tables_join_across_blanks():
    head = "| a | b |\n|---|---|\n"
    assert c.join_tables(head + "| 1 | 2 |\n\n" + head + "| 3 | 4 |\nend") == head + "| 1 | 2 |\n| 3 | 4 |\nend"
    assert c.join_tables("| 1 | 2 |\n\n|---|---|\n| 3 | 4 |") == "| 1 | 2 |\n| 3 | 4 |"
    assert c.join_tables("| 1 | 2 |\n\n| 3 |") == "| 1 | 2 |\n\n| 3 |"
    assert c.join_tables("| 1 |\nx\n| 2 |") == "| 1 |\nx\n| 2 |"
    assert c.join_tables("| 1 |\n\n| 2 |\n\n| 3 |") == "| 1 |\n| 2 |\n| 3 |"


def test_attributes_condense():
    md = "Text\nCategory:\n\nRequirement\nAllocation: HW\nPriority: Mandatory\n\nSafety: Yes Verification: Analysis [A_1]\nTest\nNA\n[B:2]\nNA\nNext"
    assert c.condense_attributes(md) == "Text\n[Category: Requirement | Allocation: HW | Priority: Mandatory | Safety: Yes | Verification: Analysis, Test]\n[A_1] [B:2]\n\nNext"
    few = "Category: x\nAllocation: y\nplain"
    assert c.condense_attributes(few) == few
    extra = "Category: a\nAllocation: b\nPriority: c\nComment: look\nNo_Out-Links: NA\nend"
    assert c.condense_attributes(extra) == "[Category: a | Allocation: b | Priority: c | Comment: look]\n\nend"


def test_requirements_are_wrapped():
    tag = "[Category: R | Allocation: HW | Priority: M]"
    md = f"# Head\n## HW-IRS_DIM_VI_275\nTOP_SRS_1500\nShall work.\n\nAnd so on.\n{tag}\n[X:1]\n\n[Y:2]\nafter"
    want = f"# Head\n\n---\n\n**HW-IRS_DIM_VI_275**\n**TOP_SRS_1500**\n\nShall work.\n\nAnd so on.\n\n{tag}\n**Traceability:** [X:1] [Y:2]\n\n---\n\nafter"
    assert c.wrap_requirements(md) == want
    assert c.wrap_requirements(f"| t |\nText.\n{tag}") == f"| t |\n\n---\n\nText.\n\n{tag}\n\n---\n"
    two = c.wrap_requirements(f"A_X_1\none\n{tag}\nB_X_2\ntwo\n{tag}")
    assert two.count("---") == 4 and "**A_X_1**" in two and "**B_X_2**" in two


def test_test_cases_are_formatted():
    md = "Before\nTest case:\nFVTR_OPT_01\nTest:\nLabels\nResult\n## passed\nmore\n[FVTSR_PAM_0002]\n[HW-IRS_PAM_266]\n## 5 NEXT\nafter"
    want = "Before\n---\n\n**Test case:** FVTR_OPT_01\n**Test:** Labels\n**Result:** passed\nmore\n**Traceability:** [FVTSR_PAM_0002] [HW-IRS_PAM_266]\n\n---\n## 5 NEXT\nafter"
    assert c.format_tests(md) == want
    empty = "Test case:\n\nTest:\nx"
    assert c.format_tests(empty) == empty
    moved = "Test case:\nTest:\nTest Item:\nFVTR_A_1\n\nName of it\n\nItem 7\n\nleft"
    assert "**Test case:** FVTR_A_1\n**Test:** Name of it\n**Test Item:** Item 7\n\nleft" in c.format_tests(moved)
    assert "**Comment:**\n| a |\n| b |" in c.format_tests("Test case:\nX_1\nComment:\n| a |\n| b |")


def test_peeled_ids():
    assert c.peel_ids("text\n[A_1][B_2]\n\n[C_3]\n") == ("text", ["[A_1][B_2]", "[C_3]"])
    assert c.peel_ids("[CD_PAM]") == ("[CD_PAM]", [])


def test_whole_cleaning(spark):
    md = (
        "# Firm\nStreet 1\nTel. 1 www.x.org\nTitle page\nPage 2 of 9\n4 Sep 2014 14:23:08\n2014\n## ACME GROUP INTERNAL\n\n| Doc | 1 |\n|---|---|\n| a | b |\n## PROJECT ACRONYM DOCUMENT TITLE\ndaugh- terboard HW- IRS\n"
        "This document is not to be reproduced in any way © ACME 2014 - All rights reserved.\n## Passed\n## Table 2: More\n**Result:** I. Name passed\n---\n\n===\nA &amp; B <!-- gone\n --> end  \n\n\n\n## END OF DOCUMENT\n"
    )
    out = spark.createDataFrame([(md,), (None,), ("",)], "md string").select(c.clean_markdown(F.col("md")).alias("x")).collect()
    assert out[0].x == "Title page\n\ndaughterboard HW- IRS\n\nPassed\nTable 2: More\n**Result:** passed\n---\nA & B  end"
    assert out[1].x is None and out[2].x == ""
