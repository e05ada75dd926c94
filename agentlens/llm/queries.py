"""The queries of this subpackage and their SQL, by registered name."""

from agentlens.llm import collocations, decontaminate, exact_copies, lexical_search, neighbours, ngram_join, page_text, quality, repeats, secrets, sentence_pieces, templates, url_filter

QUERIES = {
    "op1_sentencepiece": sentence_pieces.op1_sentencepiece,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_line_dedup": templates.op4_line_dedup,
    "op5_quality": quality.op5_quality,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_secrets": secrets.op7_secrets,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_page_text": page_text.op9_page_text,
    "op10_repeats": repeats.op10_repeats,
    "op11_collocations": collocations.op11_collocations,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_exact_dedup": exact_copies.op13_exact_dedup,
}
SQL = {**url_filter.SQL, **secrets.SQL, **ngram_join.SQL, **collocations.SQL, **lexical_search.SQL, **exact_copies.SQL}
