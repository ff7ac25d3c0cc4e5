"""A scorer for the tests: a reply picked by the length of the prompt."""

import pandas as pd

from tessera.operators.scoring import Scorer

WORDS = ("含意", "矛盾", "中立")


class RuleReplyScorer(Scorer):
    def score(self, model, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"generated": [p + WORDS[len(p) % 3] + "\n" for p in pdf["prompts"].astype(str)]})


class CountingScorer(Scorer):
    """Leaves one file per scored row and dies at a given id."""

    def score(self, model, pdf):
        import os
        import uuid

        for i in pdf["id"]:
            if i == self.options["dies_at"]:
                raise RuntimeError("killed")
            open(os.path.join(self.options["log"], f"{i}-{uuid.uuid4().hex}"), "w").close()
        return pd.DataFrame({"generated": pdf["prompts"].str.upper()})
