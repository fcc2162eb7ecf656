"""Part of topicmill; see the README for what each module holds."""
