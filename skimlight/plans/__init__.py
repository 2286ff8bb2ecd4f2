"""Query trees and their lowering to DataFrame plans."""
