"""The built-in checks: each turns a layer's rule into Spark plans and plans' counts into results."""
