"""Operators for training data: near copies, lines, tokens, toxicity, packing, secrets, pieces, archives, vector search, quality, tries, URLs, manifests.

Nothing outside this subpackage imports it. Tables between the steps of one operator are written to the shared folder
of `spark.checkpoint.dir` (see `store`), so a lost executor costs a recomputation from the last such table.
"""
