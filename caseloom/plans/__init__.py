"""Plan-level building blocks: ordered folds, stored intermediates."""
