"""A judge of answers that asks a chat model for verdicts."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from ..sources import providers

VERDICTS = "Reply with a JSON array of 0 and 1 only, one for each, in order."
#: What is asked for each metric; parts in braces are filled in.
ASKED = {
    "faithfulness": "Split the answer into statements. Say for each whether the context supports it (1) or not (0). {verdicts}\n\nContext:\n{context}\n\nAnswer:\n{answer}",
    "context_recall": "Split the reference into statements. Say for each whether the context holds it (1) or not (0). {verdicts}\n\nContext:\n{context}\n\nReference:\n{truth}",
    "context_precision": "Say for each numbered passage whether it helps to give the reference as an answer to the question (1) or not (0). {verdicts}\n\nQuestion: {question}\n\nReference:\n{truth}\n\nPassages:\n{context}",
    "answer_relevancy": "Write three questions that the answer would answer. Reply with a JSON array of strings only.\n\nAnswer:\n{answer}",
}


def array_in(reply: str) -> list:
    """The JSON array in a model's reply; an error if there is none."""
    found = re.search(r"\[.*\]", reply, re.S)
    if not found:
        raise ValueError(f"no verdicts in {reply!r}")
    return json.loads(found[0])


class ModelJudge:
    """Verdicts for ``evaluate.scored``, from a chat model and an embedder."""

    def __init__(self, llm, embedder):
        self.llm, self.embedder = llm, embedder

    def __call__(self, question: str, contexts: list[str], answer: str, truth: str | None) -> dict[str, list[float]]:
        context = "\n\n".join(f"{i}. {c}" for i, c in enumerate(contexts, 1))

        def asked(metric: str) -> list:
            parts = {"verdicts": VERDICTS, "context": context, "answer": answer, "truth": truth, "question": question}
            filled = re.sub(r"\{(\w+)\}", lambda m: str(parts[m[1]]), ASKED[metric])
            return array_in(self.llm.generate(filled, temperature=0.0))

        found = {"faithfulness": [float(v) for v in asked("faithfulness")]}
        vectors = np.array(self.embedder.embed_batch([question, *map(str, asked("answer_relevancy"))]), np.float64)
        lengths = np.linalg.norm(vectors, axis=1)
        found["answer_relevancy"] = (vectors[1:] @ vectors[0] / np.maximum(lengths[1:] * lengths[0], 1e-300)).tolist()
        if truth is not None:
            found |= {metric: [float(v) for v in asked(metric)] for metric in ("context_precision", "context_recall")}
        return found


def create_judge(model: str = "gpt-4o", embeddings_model: str = "text-embedding-3-small", api_key: str | None = None, **settings) -> ModelJudge:
    """A judge behind the OpenAI interface; it needs ``api_key`` or OPENAI_API_KEY."""
    if not (api_key or os.environ.get("OPENAI_API_KEY")):
        raise ValueError("a judge needs api_key or OPENAI_API_KEY")
    return ModelJudge(providers.OpenAIChat(model, api_key=api_key, **settings), providers.OpenAIEmbedder(embeddings_model, api_key=api_key, **settings))
