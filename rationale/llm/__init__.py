"""Training-data operators: each module holds one operator; ``registry`` lists their queries."""
