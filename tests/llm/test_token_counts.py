import public_tokenizers
import sentencepiece

from cartwheel.llm import token_counts


def truth(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [len(x) for x in model.encode([t or "" for t in texts])]


def test_counts_equal_the_library_on_all_documents(documents):
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(documents).collect()}
    docs = documents.select("doc_id", "text").collect()
    for d, n in zip(docs, truth([d["text"] for d in docs])):
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((d["text"] or "").encode()), n > 4096)


def test_edge_rows(edge_documents):
    rows = token_counts.count_tokens(edge_documents).collect()
    docs = edge_documents.collect()
    want = sorted((d["doc_id"] or -1, n) for d, n in zip(docs, truth([d["text"] for d in docs])))
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == want


def test_blanks_marks_and_special_strings():
    whole = token_counts.prove_model(token_counts.VOCABULARY)
    counts = token_counts.PretokenCounts(token_counts.VOCABULARY, whole)
    texts = [" ", "  ", " a", "a ", "a  b", "\n", "\ta b\n", "▁", "▁▁x ▁", "<s> </s>", "　a b", "x\x00y", "a   b  c "]
    assert counts.counts(texts) == truth(texts)


def test_shortcut_holds_only_whole_tokens():
    whole = token_counts.prove_model(token_counts.VOCABULARY)
    assert len(whole) > 10_000 and truth(sorted(whole)) == [1] * len(whole)


def test_empty_table(documents):
    assert token_counts.count_tokens(documents.where("false")).collect() == []
