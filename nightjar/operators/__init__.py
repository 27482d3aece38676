"""Night operators: cleaning, validation, features, folds, metrics, scoring, explanations."""
