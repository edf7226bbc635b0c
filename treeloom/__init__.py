"""treeloom: structural analytics over documents, trees and graphs on Spark."""
