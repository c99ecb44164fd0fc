"""Steps of preparing training data, each an operator on any DataFrame of documents."""
