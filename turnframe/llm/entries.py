"""The queries of this subpackage and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

from turnframe.llm.common import table
from turnframe.llm.decontaminate import OP2_SQL, op2_decontaminate
from turnframe.llm.langid import op7_langid
from turnframe.llm.linededup import OP3_SQL, op3_line_dedup
from turnframe.llm.mixing import op9_mixing
from turnframe.llm.quality import OP4_SQL, op4_quality
from turnframe.llm.secrets import op5_secrets
from turnframe.llm.simhash import op1_simhash
from turnframe.llm.sortmeans import OP12_SQL, op12_sort_means
from turnframe.llm.tokenalign import op11_token_align
from turnframe.llm.tokencounts import op10_token_counts
from turnframe.llm.tokenfile import op8_tokens
from turnframe.llm.warc import OP6_SQL, op6_warc
from turnframe.llm.wrappers import op13_wrappers


def _on(name, op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def queries() -> dict:
    return {
        "op1_simhash": _on("documents", op1_simhash),
        "op2_decontaminate": lambda spark, sf_dir: op2_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op3_line_dedup": _on("documents", op3_line_dedup),
        "op4_quality": _on("documents", op4_quality),
        "op5_secrets": _on("documents", op5_secrets),
        "op6_warc": _on("pages", op6_warc),
        "op7_langid": _on("documents", op7_langid),
        "op8_tokens": _on("documents", op8_tokens),
        "op9_mixing": lambda spark, sf_dir: op9_mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op10_token_counts": _on("documents", op10_token_counts),
        "op11_token_align": _on("documents", op11_token_align),
        "op12_sort_means": _on("embeddings", op12_sort_means),
        "op13_wrappers": _on("pages", op13_wrappers),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_quality": OP4_SQL, "op6_warc": OP6_SQL, "op12_sort_means": OP12_SQL}
