"""Places of files that operators take as parameters, for the registered queries."""

import public_tokenizers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
